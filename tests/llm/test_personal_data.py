import random
import re

import tables
from oracle_check import compare, connect

from loomlog.llm import personal_data as M

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return 12 <= len(digits) <= 19 and total % 10 == 0


CHECKS = {
    "email": lambda m: True, "ip": lambda m: all(int(p) <= 255 for p in m.split(".")), "card": lambda m: luhn(re.sub("[^0-9]", "", m)),
    "phone": lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15,
}


def brute(text):
    found = [(m.start(), k, kind, m.end()) for k, (kind, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text or "") if CHECKS[kind](m[0])]
    return sorted(found)


def base(row):
    return [(s.start, s.rank, s.kind, s.end) for s in row.spans if s.rank < 4]


def test_base_spans_against_brute_force(spark):
    rng = random.Random(1)
    parts = ["a", "b.c", "@", ".", "-", " ", "1", "23", "255", "256", "+", "(", ")", "é", "\U0001f600", "4111 1111 1111 1111", "+1 (743) 555-3824", "x.y@z-1.com", "10.0.0.1", "\n", "%", "0007"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(25)))) for i in range(1500)] + tables.odd_rows(rng)
    got = M.find(tables.documents(spark, rows)).collect()
    assert sorted((repr(r.doc_id), r.text or "", base(r)) for r in got) == sorted((repr(i), x or "", brute(x)) for i, x in rows)


def test_very_long_runs(spark):
    """Neither the stack nor the square of the length: long digit runs, addresses without a domain, thousands of matches."""
    texts = ["1" * 100_000, "a" * 100_000 + "@", "a.b@c.de " * 3_000, "1." * 20_000, "+1" + " " * 100_000, "1 " * 50_000 + "@"]
    got = {r.doc_id: r for r in M.find(tables.documents(spark, list(enumerate(texts)), extra=False)).collect()}
    assert base(got[2]) == brute(texts[2]) and base(got[0]) == [] and len(base(got[3])) == len(brute(texts[3]))


def test_method_s_own_kinds(spark):
    rows = [(1, "IBAN DE89 3704 0044 0532 0130 00 ok"), (2, "DE89370400440532013001 no"), (3, "ssn 123-45-6789"), (4, "code 123-45-6789"), (5, "ssn 000-45-6789")]
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans if s.rank >= 4] for r in M.find(tables.documents(spark, rows)).collect()}
    assert got == {1: [("iban", 5, 32)], 2: [], 3: [("ssn", 4, 15)], 4: [], 5: []}
    scores = [r.spans[0].score for r in M.find(tables.documents(spark, [(1, "call +1 (743) 555-3824"), (2, "it is +1 (743) 555-3824")])).orderBy("doc_id").collect()]
    assert scores[0] > scores[1]


def test_redaction(spark):
    rows = [*tables.odd_rows(random.Random(2)), (50, "a@b.co, 10.0.0.1; 4111 1111 1111 1111 or +1 (743) 555-3824 or 999.1.1.1 or 4111 1111 1111 1112")]
    df = tables.documents(spark, rows)
    got = M.redact(df)
    assert got.columns == df.columns
    by = {}
    for r in got.collect():
        by.setdefault(r.doc_id, set()).add(r.text)
    assert by[50] == {"[EMAIL], [IP]; [CARD] or [PHONE] or 999.1.1.1 or 4111 1111 1111 1112"}
    assert by[5] == {"A short text. With TWO sentences, mail [EMAIL] and [PHONE]."} and by[2] == {None} and by[6] == {rows[7][1]}
    assert all(not base(r) for r in M.find(got).collect())


def test_empty_table(spark):
    assert M.find(tables.documents(spark, [])).count() == 0 and M.redact(tables.documents(spark, [])).count() == 0


def test_no_python_in_the_plan(spark):
    plan = M.op8(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_query_equals_sql(spark):
    path = "/root/testdata/sf0.001"
    assert compare(M.op8(spark, path), connect(path), M.OP8_SQL).startswith("ok")
