"""Plain versions of the operators, row by row in Python."""

import base64
import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import regex

WORD = re.compile(r"[^\x20\x09-\x0D]+")
KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def pii(text):
    """(start, kind number, end) of each base span."""
    out = []
    for k, (kind, rule) in enumerate(KINDS.items()):
        for m in re.finditer(rule, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m.group().split(".")), "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


ALL_KINDS = [*KINDS, "secret"]


def span_list(spans):
    return ",".join(f"{ALL_KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _tokens(text, base):
    """(s, e, token, kind or None, patterns) of each identifier-like token."""
    words = [(m.start(), m.end(), m.group()) for m in WORD.finditer(text)]
    hit = [bool(set(w) & set("0123456789@")) for *_, w in words]
    name = ["<num>" if h else w.lower() for h, (*_, w) in zip(hit, words)]
    at = lambda i: name[i] if 0 <= i < len(name) else ""
    real = lambda w: w not in ("", "<num>")
    for i, (s, e, w) in enumerate(words):
        if not hit[i]:
            continue
        met = [(be, k) for bs, k, be in base if bs < e and s < be]
        lead, tail = len(regex.match(r"[^\p{L}\p{N}+@_]*", w).group()), len(regex.match(r"[^\p{L}\p{N}_]*", w[::-1]).group())
        token = w[lead : len(w) - tail].lower() if lead + tail < len(w) else ""
        l2, l1, r1 = at(i - 2), at(i - 1), at(i + 1)
        shape = regex.sub(r"\p{L}+", "a", re.sub("9{5,}", "9+", re.sub("[0-9]", "9", token)))
        patterns = []
        if l2 and l1 and (real(l2) or real(l1)):
            patterns.append(("l", l2, l1))
        if l1 and r1 and (real(l1) or real(r1)):
            patterns.append(("b", l1, r1))
        patterns += [("s", l1, shape)] * real(l1) + [("r", shape, r1)] * real(r1)
        yield s + lead, e - tail, token, max(met)[1] if met else None, patterns


def bootstrap(texts, support=5, confidence=0.8):
    """All spans of each text, base ones and those that contexts give: (start, kind number, end)."""
    base = [pii(t) for t in texts]
    tokens = [list(_tokens(t or "", b)) for t, b in zip(texts, base)]
    ok = lambda t: (len(re.findall("[0-9]", t)) >= 2 or "@" in t) and len(t) >= 5
    graph = defaultdict(dict)
    for rows in tokens:
        for _, _, t, k, patterns in rows:
            if k is None and re.search(r"(?<![0-9a-z])(?=[0-9a-f]*[0-9])(?=[0-9a-f]*[a-f])[0-9a-f]{32,}(?![0-9a-z])", t):
                k = 4
            for p in patterns:
                old = graph[p].get(t)
                graph[p][t] = k if old is None or k is not None and k > old else old

    def kind(patterns):
        doubt = [round(sum(math.log(1 - c) for k, c in patterns if k == i), 9) for i in range(5)]
        return doubt.index(min(doubt))

    known, confident = {}, {}
    while True:
        now = {}
        for p, strings in graph.items():
            n = Counter(known.get(t) if k is None else k for t, k in strings.items())
            most = max(n[i] for i in range(5))
            if most >= support and most / (len(strings) + 1) >= confidence:
                now[p] = next(i for i in range(5) if n[i] == most), most / (len(strings) + 1)
        grown, confident = len(now) > len(confident), now
        if not grown:
            break
        met = defaultdict(list)
        for p, how in confident.items():
            for t, k in graph[p].items():
                if k is None and ok(t):
                    met[t].append(how)
        known = {t: kind(x) for t, x in met.items()} | known
    out = []
    for b, rows in zip(base, tokens):
        more = [(s, kind([confident[p] for p in ps if p in confident]), e) for s, e, t, k, ps in rows if k is None and ok(t) and any(p in confident for p in ps)]
        out.append(sorted([*b, *more]))
    return out


def masked(text, spans):
    out, at = [], 0
    for s, k, e in spans:
        if s >= at:
            out += [text[at:s], f"<{ALL_KINDS[k]}>"]
        at = max(at, e)
    return "".join(out) + text[at:]


def rules(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    n = Counter(windows)
    covered = {i + d for i, w in enumerate(windows) if n[w] > 1 for d in range(8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text, k):
    w = WORD.findall(lower(text))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def components(ids, pairs):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def near(docs, k, percent=80):
    """{id: (set size, component)} of {id: text}, by comparing all pairs that share a shingle."""
    sets = {i: shingles(t, k) for i, t in docs.items()}
    holders = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    pairs = {p for h in holders.values() for p in itertools.combinations(h, 2)}
    links = [(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    of = components(sets, links)
    return {i: (len(s), of[i]) for i, s in sets.items()}


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def tokenizer():
    import public_tokenizers as p
    import tiktoken

    with open(p.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=ranks, special_tokens={})


def bpe(encoding, text):
    """n_tokens, ids_sha256, decoded_sha256."""
    ids = encoding.encode_ordinary(text or "")
    return len(ids), sha(b"".join(i.to_bytes(4, "little") for i in ids)), sha((text or "").encode())


def chats(rows):
    """{conv_id: (n_turns, turns_sha256, loss_chars, loss_sha256)} of (conv_id, turn, role, text)."""
    out = {}
    for conv, turns in itertools.groupby(sorted(rows, key=lambda r: (r[0], r[1], r[2] or "", r[3] or "")), key=lambda r: r[0]):
        turns = [(r[2] or "", r[3] or "") for r in turns]
        loss = "".join(t for r, t in turns if r == "assistant")
        out[conv] = len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss)
    return out


def tokens(pieces, byte_score, word, longest=10**9):
    """The fewest tokens of a most probable segmentation, over all prefixes; no piece has more characters than ``longest``."""
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        n = len(word[end - 1].encode())
        s, t = best[end - 1]
        options = [(s + n * byte_score, -(t + n))]
        options += [(best[i][0] + pieces[word[i:end]], -(best[i][1] + 1)) for i in range(max(0, end - longest), end) if word[i:end] in pieces]
        s, t = max(options)
        best.append((s, -t))
    return best[-1][1]
