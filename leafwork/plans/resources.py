"""How many jobs a host carries; arithmetic for plug-ins that run engines of their own.  Spark schedules everything else."""

from __future__ import annotations

RESERVED_CPUS, RESERVED_MB = 1, 1536
#: Memory of one job by provider.
JOB_MB = {"paddleocr": 4800, "tesseract": 600}


def fit(total: int | None, each: int, reserved: int) -> int | None:
    """How many jobs of a size fit beside what is reserved; None if the total is unknown."""
    return None if total is None or each <= 0 else max(0, (total - reserved) // each)


def concurrency(provider: str, cpus: int, memory_mb: int | None) -> int:
    """Documents at once: by memory and processors, at least 1."""
    by_memory = fit(memory_mb, JOB_MB.get(provider, JOB_MB["paddleocr"]), RESERVED_MB)
    return max(1, min(x for x in (cpus - RESERVED_CPUS, by_memory) if x is not None))


def workers(requested: int, cpus: int, free_mb: int | None, least: int = 1, each_mb: int = 4800) -> int:
    """Workers of one document; where the memory is not known, the processors alone count."""
    by_memory = fit(free_mb, each_mb, RESERVED_MB)
    return max(least, min(x for x in (requested, cpus - 3, by_memory) if x is not None))


def workers_each(provider: str, concurrent: int, cpus: int, memory_mb: int | None) -> int | None:
    """Workers of each of several documents at once: an equal part of what fits; None for engines without workers."""
    if provider != "paddleocr":
        return None
    by_memory = fit(memory_mb, JOB_MB[provider], RESERVED_MB)
    return max(1, min(x for x in (cpus - RESERVED_CPUS, by_memory) if x is not None) // max(1, concurrent))


def disk_needed_mb(pages: int, base_mb: int = 1024, page_mb: int = 6) -> int:
    return base_mb + page_mb * pages


def check_disk(free_mb: int, pages: int) -> None:
    """Refuses a file that would leave too little of a local disk."""
    need = disk_needed_mb(pages)
    if free_mb < need:
        raise ValueError(f"{free_mb} MB are free, {need} MB are needed")


def _number(path: str) -> int | None:
    try:
        with open(path) as f:
            return int(f.read().split()[0])
    except (OSError, ValueError, IndexError):
        return None


def host(cgroup: str = "/sys/fs/cgroup") -> tuple[int, int | None]:
    """(processors, memory in MB or None) of this host, or of its container where that has less."""
    import os

    cpus = os.cpu_count() or 1
    try:
        with open(f"{cgroup}/cpu.max") as f:
            quota, period = f.read().split()
        if quota != "max":
            cpus = min(cpus, max(1, int(quota) // int(period)))
    except (OSError, ValueError):
        pass
    pages, size = (os.sysconf(n) if n in os.sysconf_names else None for n in ("SC_PHYS_PAGES", "SC_PAGE_SIZE"))
    memory = [m for m in (pages * size if pages and size else None, _number(f"{cgroup}/memory.max")) if m]
    return cpus, min(memory) // 2**20 if memory else None
