import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def texts():
    """Texts with near copies, repeats, personal data, odd characters, nulls and empties."""
    r = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "Über", "naïve", "word", "of", "the", "x1", "##", "日本"]
    some = lambda n: " ".join(r.choice(words) + str(r.randrange(40)) for _ in range(n))
    base = [some(n) for n in (1, 3, 4, 5, 9, 30, 80, 200, 2500)]
    out = [None, "", "  \n\t ", *base]
    for b in base[5:]:
        for k in range(6):
            w = b.split(" ")
            for _ in range(k * len(w) // 60 + 1):
                w[r.randrange(len(w))] = "edit" + str(r.randrange(9))
            out.append(" ".join(w))
    line = "a line with quite a few words that comes again and again"
    out += [base[6], base[6].upper(), f"{line}\n{line}\nother\n\n{line}", (line + " ") * 9]
    out += [
        "mail a.b+c@d-e.org, x@y and q@r.s_t@u.v.w; ip 10.0.0.255 10.0.0.256 1.2.3.4.5.6.7.8 00010.2.3.4",
        "card 4111 1111 1111 1111 or 4111-1111-1111-1111 or 4111111111111112 or 0000000000000000000 +1 (555) 010-9999 +12 3",
        "ü+49 30 1234567890 é 79927398713 +1234567890123456 日本@x.y",
        "a" * 5000 + "@" + "b.c" * 3000, "1" * 9000, "1." * 5000, "+" + "(" * 4000, "\\### Assistant: </turn> ok",
    ]
    return dict(enumerate(out))


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}" if i % 7 else None, len(t or "")) for i, t in texts.items()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).cache()
