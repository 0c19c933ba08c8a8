"""Links of secret parts against all pairs of parts."""

import random
import re

from metricspark.llm import secrets


def all_spans(x):
    """Every kind's spans: base ones as they are, weak ones with a complementary part within the scope."""
    parts = []
    for rank, (kind, (role, pattern, group, least)) in enumerate(secrets.KINDS.items()):
        parts += [(m.start(), rank, m.end(), kind, role) for m in re.finditer(pattern, x, re.ASCII) if len(m[group]) >= least]
    out = []
    for s, rank, e, kind, role in sorted(parts):
        near = any(r in secrets.PARTNERS[role] and b <= e + secrets.SCOPE and f >= s - secrets.SCOPE for b, _, f, _, r in parts)
        if kind in secrets.BASE or near:
            out.append(f"{kind}:{s}:{e}")
    return ",".join(out)


def test_links_against_all_pairs(spark):
    rnd = random.Random(7)
    made = [lambda: "user=bob", lambda: "client_id: abc.def", lambda: "password=" + "z" * rnd.randrange(3, 500),
            lambda: "AKIA" + "B" * rnd.randrange(10, 30), lambda: "0123456789abcdef" * rnd.randrange(1, 4),
            lambda: "aB3" * rnd.randrange(8, 100), lambda: "https://a.example/x?" + "q" * rnd.randrange(1, 600),
            lambda: "10.0.0.1:80", lambda: "é日本" * rnd.randrange(1, 5)]
    rows = []
    for k in range(300):
        text = ""
        for _ in range(rnd.randrange(6)):
            text += rnd.choice(made)() + rnd.choice([" ", "\n", " " * rnd.randrange(150, 260), " x" * 100])
        rows.append((k, text))
    got = {r.doc_id: r.spans for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    weak = 0
    for k, text in rows:
        assert got[k] == all_spans(text), text
        weak += sum(s.split(":")[0] not in secrets.BASE for s in got[k].split(",") if s)
    assert weak > 50
