"""The filter audit against plain permutations and against its DuckDB statement on odd rows."""

import random
from itertools import permutations

import brute
import duckdb
import pandas as pd

from wattloom.llm import interactions
from wattloom.llm.queries import OP12_SQL


def plain_failures(docs):
    """Sets of failed filters of (id, text) rows."""
    least = {}
    for i, t in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    out = []
    for i, t in docs:
        t = t or ""
        w = brute.words(t)
        out.append({f for f, bad in zip("ABCDE", (
            len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t),
            any(c in "#$%&*|" for c in t), i is not None and least[t] < i)) if bad})
    return out


def plain_audit(rows):
    """rows: (part, failed set, good, toxic) -> {(part, order, step): counts}."""
    out = {}
    for part in {r[0] for r in rows}:
        own, total, told = [r for r in rows if r[0] == part], dict.fromkeys("ABCDE", 0), {}
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                total[f] += len(gone)
                told["".join(order), step] = (len(left), len(gone), sum(f in r[1] for r in own) - len(gone), sum(r[1] == {f} for r in own),
                                              sum(r[2] for r in gone), sum(r[3] for r in gone))
        out |= {(part, o, s): (*c, total[o[s - 1]]) for (o, s), c in told.items()}
    return out


def audited(df):
    return {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in df.collect()}


def test_audit_equals_plain_permutations(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["en", "fr", ""]), {f for f in "ABCDE" if rng.random() < 0.3}, rng.randrange(2), rng.randrange(2)) for _ in range(400)]
    mask = lambda s: sum(1 << "ABCDE".index(f) for f in s)
    df = spark.createDataFrame([(p, mask(s), g, t) for p, s, g, t in rows], "part string, fails int, good long, toxic long")
    counted = df.selectExpr(
        "part", "fails", "1L AS n", "good", "toxic").groupBy("part", "fails").sum("n", "good", "toxic").toDF("part", "fails", "n", "good", "toxic")
    assert audited(interactions.audit(counted)) == plain_audit(rows)


def test_shapley_values_are_exact():
    rng = random.Random(4)
    for n in (2, 3, 4, 5):
        v = [0] + [rng.randrange(1000) for _ in range((1 << n) - 1)]
        share = [0] * n
        for order in permutations(range(n)):
            seen = 0
            for f in order:
                share[f] += v[seen | 1 << f] - v[seen]
                seen |= 1 << f
        count = len(list(permutations(range(n))))
        assert [x * count for x in interactions.shapley(v, n)] == share


def test_odd_rows(spark, frame, odd_rows):
    shout = "SHOUTING WORDS & SIGNS " * 120
    rows = odd_rows + [(40, shout), (39, shout), (41, "É" * 300 + " A"), (42, None), (None, None)]
    docs = frame(rows)
    # several labels of one id, ids without a document, null labels, a column of the same name as a result
    labels = spark.createDataFrame([(1, 1, 0, "x"), (1, 0, 1, "x"), (3, None, 1, "x"), (39, 0, 1, "x"), (40, 1, 1, "x"), (99, 1, 1, "x"), (None, 1, 1, "x")],
                                   "doc_id long, quality int, toxic int, part string")
    failed = interactions.failures(docs)
    got = sorted((str(r.id), r.fails) for r in failed.collect())
    assert got == sorted((str(i), sum(1 << "ABCDE".index(f) for f in s)) for (i, _), s in zip(rows, plain_failures(rows)))
    result = interactions.audit(interactions.tallies(failed, labels))
    good, toxic = {1, 40}, {1, 3, 39, 40}
    assert audited(result) == plain_audit([("en", s, int(i in good), int(i in toxic)) for (i, _), s in zip(rows, plain_failures(rows))])
    con = duckdb.connect()
    con.register("documents", docs.toPandas().assign(doc_id=lambda d: d.doc_id.astype("Int64")))
    con.register("labels", labels.toPandas().astype({c: "Int64" for c in ("doc_id", "quality", "toxic")}))
    twin = con.sql(OP12_SQL).df()
    assert {(r.part, r.filter_order, r.step): tuple(r)[4:] for r in twin.itertuples()} == audited(result)


def test_empty_tables_and_null_parts(spark, frame):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert interactions.audit(interactions.tallies(interactions.failures(frame([])), labels)).count() == 0
    docs = spark.createDataFrame([(1, "a", None), (2, "a", ""), (3, "b", "de")], "doc_id long, text string, lang string")
    rows = interactions.audit(interactions.tallies(interactions.failures(docs), labels)).toPandas()
    assert isinstance(rows, pd.DataFrame) and len(rows) == 1200 and set(rows.part) == {"", "de"}
    assert rows[(rows.part == "") & (rows.filter_order == "EABCD") & (rows.step == 1)].removed.tolist() == [1]
