"""The tables of the data model."""

from __future__ import annotations

COMMON = "id string, created_at timestamp, updated_at timestamp"
BBOX = "struct<x1:double,y1:double,x2:double,y2:double>"
CELL = f"struct<row:int,column:int,rowspan:int,colspan:int,text:string,bbox:{BBOX},align_h:string,align_v:string,confidence:double,is_header:boolean,is_edited:boolean>"
TABLE = f"struct<rows:array<struct<cells:array<{CELL}>>>,column_widths:array<double>,row_heights:array<double>,border_style:map<string,string>,detection_method:string>"
RUN = "struct<text:string,bold:boolean,italic:boolean,font_size:double,language:string,confidence:double,source_ocr_block_ids:array<string>>"
BLOCK = f"struct<id:string,type:string,bbox:{BBOX},bbox_norm:{BBOX},confidence:double,z_order:int,content:array<{RUN}>,table:{TABLE},image_ref:string,style:map<string,string>,is_edited:boolean>"
PAGE = f"struct<document_id:string,page_id:string,page_number:int,page_width:int,page_height:int,dpi:int,rotation:double,blocks:array<{BLOCK}>>"

_DDL = {
    "documents": "original_filename string, file_extension string, mime_type string, file_size_bytes long, page_count int, status string, ocr_provider string, preprocess_profile string, dpi int, storage_original_path string, document_hash string, is_deleted boolean, error_message string, uploaded_by string",
    "document_pages": f"document_id string, page_number int, width int, height int, dpi int, rotation double, original_image_path string, processed_image_path string, ocr_status string, layout_status string, table_status string, ocr_confidence_avg double, layout_confidence_avg double, table_confidence_avg double, visual_similarity_score double, document_json {PAGE}",
    "ocr_blocks": f"document_id string, page_id string, block_id string, line_id string, word_id string, text string, confidence double, bbox {BBOX}, polygon array<struct<x:double,y:double>>, language string, font_size_estimate double, reading_order_index int, corrected_text string, is_reviewed boolean",
    "layout_blocks": f"page_id string, block_type string, bbox {BBOX}, confidence double, z_order int, content struct<word_ids:array<string>,text:string>, style map<string,string>, is_edited boolean, edited_text string",
    "tables": f"page_id string, layout_block_id string, bbox {BBOX}, n_rows int, n_cols int, confidence double, detection_method string, column_widths array<double>, row_heights array<double>, border_style map<string,string>",
    "table_cells": f"table_id string, row int, column int, rowspan int, colspan int, text string, confidence double, bbox {BBOX}, align_h string, align_v string, is_header boolean, is_edited boolean, edited_text string",
    "processing_jobs": "document_id string, status string, stage string, progress_percent int, celery_task_id string, ocr_provider string, preprocess_profile string, dpi int, started_at timestamp, finished_at timestamp, error_message string",
    "export_files": "document_id string, export_type string, storage_path string, file_size_bytes long",
    "accession_records": "document_id string, accession_number string, book_name string, creator string, author string, publisher string, language string, year_of_publication string, record_type string, total_pages int, record_date date, needs_review boolean, extraction_notes string",
    "ocr_batches": "ocr_provider string, dpi int, preprocess_profile string, uploaded_by string, started_at timestamp",
    "ocr_batch_items": "batch_id string, document_id string, processing_job_id string, position int, state string, priority_score double, attempts int, error_message string, celery_task_id string, claimed_at timestamp",
}
#: The schema of each table, in DDL.
TABLES: dict[str, str] = {name: f"{COMMON}, {ddl}" for name, ddl in _DDL.items()}

_BOX = "x1 double, y1 double, x2 double, y2 double"
_KEY = "doc_id long, page int, version long"
#: The tables of a PageStore, each keyed by document and page.
STORED: dict[str, str] = {
    "pages": f"{_KEY}, page_width int, page_height int, config_hash string, ocr_confidence_avg double, layout_confidence_avg double, table_confidence_avg double, is_deleted boolean",
    "words": f"{_KEY}, li int, wi int, text string, {_BOX}, font_size int, confidence double, corrected_text string",
    "blocks": f"{_KEY}, z_order int, block_type string, {_BOX}, confidence double, text string, font double, alignment string, table_no int, image_ref string, edited_text string, is_edited boolean",
    "tables": f"{_KEY}, table_no int, {_BOX}, confidence double, method string",
    "cells": f"{_KEY}, table_no int, row int, column int, rowspan int, colspan int, text string, {_BOX}, confidence double, align_h string, align_v string, is_header boolean, edited_text string, is_edited boolean",
}
