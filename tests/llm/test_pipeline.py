"""The pipeline against plain versions of its stages."""

import collections

import corpus_pipeline
from motionlake.llm.common import documents
from tests.conftest import SF_SMALL
from tests.llm.test_operators import brute_join


def test_stages(spark):
    docs, kept = documents(spark, SF_SMALL), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF_SMALL)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        kept[name] = collections.Counter(r["doc_id"] for r in out.collect())
        docs = out
    first, second, third, fourth = kept.values()
    assert 0 < sum(second.values()) < sum(first.values()) < 200 and third == second and set(fourth) <= set(third)
    assert all("password=" not in r["text"] for r in docs.collect())
    packed = corpus_pipeline.run(spark, SF_SMALL).collect()
    assert collections.Counter(r["doc_id"] for r in packed if r["piece"] == 0) == fourth
    room = collections.defaultdict(list)
    for r in packed:
        room[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in room.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(room) <= 1.05 * -(-sum(r["length"] for r in packed) // 1024) + 1


def test_near_duplicates_are_decided_by_row(spark):
    one, two, other = ("".join(f"{w}{i} " for i in range(40)) for w in "abc")
    rows = [(5, one), (5, one), (5, two), (7, one), (7, other), (9, two), (None, one), (None, one), (11, ""), (12, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], documents(spark, SF_SMALL).schema).repartition(4)
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.single(spark, docs, SF_SMALL).collect()]
    assert sorted(got, key=str) == sorted([(5, one), (5, two), (7, other), (None, one), (None, one), (11, ""), (12, "")], key=str)


def test_near_duplicates_match_brute_force(spark):
    docs = corpus_pipeline.good(spark, documents(spark, SF_SMALL), SF_SMALL)
    want = {i: c for i, (_, c) in brute_join([(r["doc_id"], r["text"]) for r in docs.collect()]).items()}
    got = sorted(r["doc_id"] for r in corpus_pipeline.single(spark, docs, SF_SMALL).collect())
    assert got == sorted(i for i, c in want.items() if c == i) and len(got) < len(want)


def test_stages_of_odd_rows(spark):
    """Null, empty, long and repeated rows, no rows, and columns with the names that stages use inside."""
    body = " ".join(f"w{i} and the word" for i in range(40))
    rows = [(1, None, "s"), (2, "", None), (3, " ".join(f"x{i} of it" for i in range(20000)), "s"), (4, body, "t"), (4, body, "t"), (5, body + " password = hunter22xx", "t"),
            (None, body + " more", None), (6, body.replace("word", "token: abcdefgh12"), None)]
    docs = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], documents(spark, SF_SMALL).schema)
    docs = docs.selectExpr("*", "1 as _row", "2 as _spans", "3 as _blob", "4 as row", "5 as doc", "6 as _copy", "7 as component_id").repartition(3)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.filter("false"), SF_SMALL).count() == 0, name
        out = stage(spark, docs, SF_SMALL)
        if name == "packing":
            assert {r["doc_id"] for r in out.collect()} == {r[0] for r in rows}
            continue
        assert out.columns == docs.columns, name
        got = out.collect()
        assert {(r["_row"], r["_spans"], r["_blob"], r["row"], r["doc"], r["_copy"], r["component_id"]) for r in got} == {(1, 2, 3, 4, 5, 6, 7)}, name
        if name == "quality_rules":
            assert {1, 2}.isdisjoint(r["doc_id"] for r in got)
        if name == "near_duplicates":
            assert sorted(str(r["doc_id"]) for r in got) == sorted(map(str, [1, 2, 3, 4, None, 6]))
        if name == "secrets":
            texts = {r["doc_id"]: r["text"] for r in got}
            assert texts[5] == body + " [secret]" and texts[1] is None and "abcdefgh12" not in texts[6] and len(got) == len(rows)
