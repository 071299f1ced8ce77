"""Brute-force versions, planted cases and odd inputs of the text operators."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from motionlake.llm import common, exchange, mixing, packing, pii, quality, secrets, setjoin, substring, suffix, topk, toxicity

LONG = "word " * 30000


def table(spark, rows, extra=False):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    df = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], schema)
    return df.selectExpr("*", "1 as size", "2 as taken", "3 as length", "4 as _row", "5 as hits", "6 as marks") if extra else df


def lines(rng, n, words="abcdefgh"):
    return " ".join("".join(rng.choice(words) for _ in range(rng.randint(1, 5))) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, clashing column names."""
    rng = random.Random(1)
    body = lines(rng, 80)
    rows = [(1, None, "a"), (2, "", None), (3, LONG, "a"), (4, body, "b"), (5, body, "b"), (5, body, "b"), (None, body, "b"), (7, " \t\n", "c"), (8, "é " * 40, None)]
    return table(spark, rows, extra=True)


@pytest.fixture(scope="module")
def empty(spark):
    return table(spark, [(1, "x", "a")]).filter("false")


RUNS = {
    "mix": mixing.mix, "emit": mixing.emit, "pack": packing.pack, "pii": pii.pseudonymise, "quality": quality.measure, "keep": quality.keep,
    "secrets": lambda d: secrets.scan(d, secrets.fresh_ledger(d.sparkSession)), "substring": substring.dedup, "suffix": suffix.dedup, "join": setjoin.join,
}
ONCE = {"mix", "pii", "quality", "secrets", "substring", "suffix", "join"}


@pytest.mark.parametrize("name", RUNS)
def test_odd_rows(odd, empty, name):
    assert RUNS[name](empty).count() == 0
    got = RUNS[name](odd).collect()
    if name in ONCE:
        assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r["doc_id"]) for r in odd.collect())
    if name in ("emit", "keep"):
        assert set(got[0].asDict()) == set(odd.columns)


def test_mix_targets(spark):
    rng = random.Random(2)
    docs = table(spark, [(i, "w " * rng.randint(1, 60), f"s{i % 4}" if i % 9 else None) for i in range(3000)] + [(5000, "w", "tiny")])
    got = mixing.mix(docs).collect()
    assert all(r["taken"] <= 3 * r["size"] and r["target"] <= 3 * r["source_size"] + 1e-9 for r in got)
    total, targets, taken = sum(r["size"] for r in got), {}, collections.Counter()
    for r in got:
        targets[r["source_size"]] = r["target"]
        taken[r["source_size"]] += r["taken"]
    assert abs(sum(targets.values()) - total) < 1e-6 * total
    spread = collections.Counter()
    for r in got:
        spread[r["source_size"]] += r["size"] ** 2 / 4
    assert all(abs(taken[s] - t) <= 4 * spread[s] ** 0.5 for s, t in targets.items())
    assert sorted(map(tuple, mixing.mix(docs).collect()), key=str) == sorted(map(tuple, got), key=str)
    emitted = {r["doc_id"]: r["count"] for r in mixing.emit(docs).groupBy("doc_id").count().collect()}
    assert emitted == {r["doc_id"]: r["copies"] for r in got if r["copies"]}


def plain_copies(rows, rates, seed="mix"):
    """Copies of every (id, source, text), by the rule of the operator in plain Python."""
    seen, out = collections.Counter(), collections.Counter()
    sha = lambda x: hashlib.md5(x.encode()).hexdigest()
    for i, t, s in rows:
        code = sha("|".join(["n" if i is None else f"i{i}", "n" if t is None else sha(t), "n" if s is None else f"s{s}"]))
        u = int(sha(f"{seed}|{code}|{seen[code]}")[:13], 16) / 16**13
        seen[code] += 1
        out[(i, t, s)] += int(rates[s]) + (u < rates[s] - int(rates[s]))
    return {k: n for k, n in out.items() if n}


def test_mix_without_ids_and_with_repeats(spark):
    """Rows without id, with one id, and repeated rows: near the target, and equal to the plain rule."""
    rng = random.Random(12)
    rows = ([(None, lines(rng, rng.randint(1, 9)), "a") for _ in range(1500)] + [(7, lines(rng, rng.randint(1, 9)), "b") for _ in range(1500)]
            + [(8, "same text here", "c")] * 1500 + [(None, None, None)] * 5 + [(i, "", "d") for i in range(5)])
    docs = table(spark, rows, extra=True).repartition(7)
    got = mixing.mix(docs).collect()
    size, target, taken = collections.Counter(), {}, collections.Counter()
    for i, t, s in rows:
        size[s] += len((t or "").split())
    of = {None: "a", 7: "b", 8: "c"}
    for r in got:
        if r["size"]:
            target[of[r["doc_id"]]] = r["target"]
            taken[of[r["doc_id"]]] += r["taken"]
    assert all(abs(taken[s] - target[s]) < 0.1 * target[s] for s in "abc")
    rates = {s: target[s] / size[s] if size[s] else 0 for s in size}
    emitted = mixing.emit(docs).groupBy("doc_id", "text", "source").count().collect()
    want = plain_copies(rows, rates)
    assert {(r["doc_id"], r["text"], r["source"]): r["count"] for r in emitted} == want
    assert sum(r["copies"] for r in got) == sum(want.values())


def test_slots_match_and_fill():
    rng = random.Random(3)
    for _ in range(60):
        cap = rng.choice([12, 30, 100])
        counts = {n: rng.randint(0, 40) for n in range(1, cap + 1)}
        table_, used, seen = packing.slots(counts, cap), collections.defaultdict(list), collections.Counter()
        for n, a, b, sequence, offset in table_:
            for k in range(b - a):
                used[sequence + k].append((offset, n))
                seen[n] += 1
        assert seen == {n: c for n, c in counts.items() if c}
        for parts in used.values():
            at = 0
            for offset, n in sorted(parts):
                assert offset == at
                at += n
            assert at <= cap and sum(3 * n > cap for _, n in parts) <= 2
        least = -(-sum(n * c for n, c in counts.items()) // cap)
        assert len(used) <= max(1.25 * least, sum(c for n, c in counts.items() if 2 * n > cap)) + 1


def test_pack_gives_all_ids(spark):
    from tokenizers import Tokenizer
    import public_tokenizers

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(4)
    texts = ["", "<|endoftext|> naïve £ 日本", *(lines(rng, rng.randint(1, 900)) for _ in range(40))]
    got = packing.pack(table(spark, [(i, t, "a") for i, t in enumerate(texts)]), with_ids=True).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"] <= 1024
    for i, t in enumerate(texts):
        pieces = sorted(by[i], key=lambda r: r["piece"])
        assert sum((r["ids"] for r in pieces), []) == tok.encode(t, add_special_tokens=False).ids + [2]
        assert [r["length"] for r in pieces[1:]] == [1024] * (len(pieces) - 1)


def test_pack_takes_the_marker_as_one_id(spark):
    from tokenizers import Tokenizer
    import public_tokenizers

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["x <|endoftext|> y", "<|endoftext|>", "a<|endoftext|><|endoftext|>\n b", " <|endoftext|", "<|EndOfText|> naïve"]
    got = {r["doc_id"]: r["ids"] for r in packing.pack(table(spark, [(i, t, "a") for i, t in enumerate(texts)]), with_ids=True).collect()}
    assert got == {i: tok.encode(t, add_special_tokens=False).ids + [2] for i, t in enumerate(texts)} and 50256 in got[0]


def test_topk_is_exact(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 40))
    rows = [(i, [float(x) for x in base[i % 40] + rng.normal(size=40) * (0 if i % 3 else 0.7)]) for i in range(900)]
    df = spark.createDataFrame([*rows, (None, rows[0][1]), (5000, None), (5001, [1.0])], "vec_id long, embedding array<double>")
    got = sorted(map(tuple, topk.search(df, F.col("vec_id") % 50 == 0, k=7, dims=40, per_shard=200).collect()))
    codes, want = np.array([np.array(v, np.float32) > 0 for _, v in rows]), []
    for q in range(0, 900, 50):
        far = (codes != codes[q]).sum(1)
        order = sorted((int(far[i]), i) for i in range(900) if i != q)[:7]
        want += [(q, k + 1, i, d) for k, (d, i) in enumerate(order)]
    assert got == sorted(want)
    assert topk.search(df.filter("false"), F.col("vec_id") % 50 == 0).count() == 0


def test_topk_of_repeated_ids(spark):
    rng = np.random.default_rng(15)
    base = rng.normal(size=(12, 20))
    rows = [(int(rng.integers(0, 60)), [float(x) for x in base[rng.integers(0, 12)] + rng.normal(size=20) * rng.choice([0, 0.4])]) for _ in range(400)]
    rows += [(7, [float(x) for x in rng.normal(size=20)]) for _ in range(150)] + [rows[0]] * 60 + [(61, [None] * 20), (62, rows[3][1][:19] + [None])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as distance", "2 as shard", "3 as _s").repartition(5)
    bits = lambda v: np.array([x is not None and np.float32(x) > 0 for x in v])
    far, codes = {}, [(i, bits(v)) for i, v in rows]
    for q, a in codes:
        for i, b in codes:
            if q % 5 == 0 and i != q:
                far[q, i] = min(far.get((q, i), 99), int((a != b).sum()))
    want = []
    for q in {q for q, _ in far}:
        want += [(q, r + 1, i, d) for r, (d, i) in enumerate(sorted((d, i) for (p, i), d in far.items() if p == q)[:7])]
    for per_shard in (100, 1 << 14):
        got = sorted(map(tuple, topk.search(df, F.col("vec_id") % 5 == 0, k=7, dims=20, per_shard=per_shard).collect()))
        assert got == sorted(want)
    few = spark.createDataFrame([(i // 2, [float(x) for x in base[i]]) for i in range(6)], "vec_id long, embedding array<double>")
    assert sorted((r["query_id"], r["vec_id"]) for r in topk.search(few, F.col("vec_id") < 2, k=2).collect()) == [(0, 1), (0, 2), (1, 0), (1, 2)]


@pytest.mark.parametrize("lengths, dims", [([1, 0, 0, 0, 20, 20, 30], 20), ([30, 20, 20, 30], 20)])
def test_topk_takes_the_most_frequent_size(spark, lengths, dims):
    df = spark.createDataFrame([(i, [1.0] * n) for i, n in enumerate(lengths)], "vec_id long, embedding array<double>").coalesce(1)
    got = topk.search(df, F.lit(True)).collect()
    a, b = (i for i, n in enumerate(lengths) if n == dims)
    assert sorted((r["query_id"], r["vec_id"]) for r in got) == [(a, b), (b, a)]


def test_surrogates_are_distinct_and_coreferent(spark):
    texts = ["mail Ann.Lee42@Mail.example.org or ann.lee42@mail.example.org", "ann.lee42@mail.example.org, call +1 (988) 555-2485", "call +1 988 555 2485 from 10.2.255.7.",
             "Mrs. Maria Lopez met Mr. Lopez", "card 4041894974608795 and 4041-8949-7460-8795", "Г-жа Иванова", "nothing here", "hex 7602ad27cf5550de1c 12345678901234567890abc"]
    got = {r["doc_id"]: r["text"] for r in pii.pseudonymise(table(spark, [(i, t, "a") for i, t in enumerate(texts)])).collect()}
    a, b = got[0].split()[1], got[0].split()[3]
    assert a.lower() == b.lower() == got[1].split(",")[0] and a != b and a[0].isupper() and a.lower().endswith(".org") and "lee" not in a.lower()
    one, two = "".join(filter(str.isdigit, got[1].split("call")[1])), "".join(filter(str.isdigit, got[2].split(" from")[0]))
    assert one == two and one[0] == "1" and one != "19885552485" and got[2].endswith(".") and "10.2.255.7" not in got[2]
    cards = got[4].split()
    assert cards[1] == cards[3].replace("-", "") and pii.luhn(cards[1]) == pii.luhn("4041894974608795") and cards[1][0] == "4"
    assert "Lopez" not in got[3] and got[3].startswith("Mrs. ") and pii.script_of(got[5].split()[1]) == "cyrillic"
    assert (got[6], got[7]) == (texts[6], texts[7])


def test_numbers_that_are_no_cards_stay():
    for text in ("1995 1996 1997 1998", "1 2 3 4 5 6 7 8 9 10 11 12 13", "2024-01-02 2024-01-03", "4111 1111 1111 1112", "id 4111111111111112", "4111 1111-1111 1111", "41 11 11 11 11 11 11 11"):
        assert pii.entities(text) == [], text
    for card in ("4111111111111111", "4111 1111 1111 1111", "4111-1111-1111-1111", "3782 822463 10005", "3056 930902 5904", "4222222222222"):
        for text in (card, f"pay {card}, 2", f"1995 {card} 7", f"1996 1997 {card} 12"):
            assert [(text[a:b], k) for a, b, k, _ in pii.entities(text)] == [(card, "card")], text


def test_names_without_title_and_phones_without_separator(spark):
    texts = ["Mrs. Maria Lopez came. Lopez said so, LOPEZ did, Maria's too; a lopez, Lopezia", "Dr Lopez", "Mr Lopez", "Lopez alone", "Mrs Weber and Prof. Weber", "Dr. Weber",
             "call +14155552671 or +1 (415) 555-2671", "ring +493012345678 or +49 30 12345678", "sum +1234567 and x+14155552671"]
    got = {r["doc_id"]: r for r in pii.pseudonymise(table(spark, [(i, t, "a") for i, t in enumerate(texts)])).collect()}
    w = got[0]["text"].replace(".", "").replace(",", "").replace("'s", "").split()
    assert w[2] == w[4] == w[7].capitalize() and w[7].isupper() and w[1] == w[9] and w[11:] == ["a", "lopez", "Lopezia"] and got[0]["n_name"] == 5
    assert got[1]["text"] == f"Dr {w[2]}" and got[2]["text"] == f"Mr {w[2]}" and got[3]["text"] == texts[3]
    a, b = got[4]["text"].split()[1::3]
    assert a == b == got[5]["text"].split()[1] != "Weber" and a.endswith(tuple(pii.ENDINGS["latin", "f"]))
    assert w[1].endswith(tuple(pii.ENDINGS["latin", "f"])) and w[2].endswith(tuple(pii.ENDINGS["latin", "n"]))
    for i, code in ((6, "1"), (7, "49")):
        one, two = ("".join(filter(str.isdigit, x)) for x in got[i]["text"].split(" or "))
        assert one == two != "".join(filter(str.isdigit, texts[i].split(" or ")[0])) and one.startswith(code) and got[i]["n_phone"] == 2
    assert got[8]["text"] == texts[8]


def test_colliding_surrogates_move(spark):
    found = spark.createDataFrame([("ip", "x" * i) for i in range(1, 8)], "kind string, norm string")
    assert len({r["new"] for r in _settled(pii, found, spark)}) == 7


def test_full_classes_are_left(spark):
    nine = range(1, 10)
    real = [("ip", f"{a}.{b}.{c}.{d}") for a in nine for b in nine for c in nine for d in nine]
    real += [("email", f"{c}@{host}.com") for c in "abcdefghijklmnopqrstuvwxyz" for host in "abcdefghijklmnopqrstuvwxyz"]
    real += [("phone", f"12:{n}") for n in range(1000, 10000)]

    def make(frames):
        for f in frames:
            assert (f["attempt"] < 20).all(), "no free surrogates"
            f["new"] = [pii.surrogate(k, n, a, b"") for k, n, a in zip(f["kind"], f["norm"], f["attempt"])]
            yield f

    got = pii.settle(spark.createDataFrame(real, "kind string, norm string"), b"", common.Scratch(spark), make).collect()
    assert {(r["kind"], r["norm"]) for r in got} == {*real} and len({(r["kind"], r["new"]) for r in got}) == len(real) == len(got)
    assert not {(r["kind"], r["new"]) for r in got} & {*real}
    assert pii.rendered("+12 34 56", "phone", "12:98765") == "+12 98 765"


def _settled(module, found, spark):
    surrogate = lambda kind, norm, attempt, key: f"{attempt}:{len(norm) % 2}"

    def make(frames):
        for f in frames:
            f["new"] = [surrogate(k, n, a, b"") for k, n, a in zip(f["kind"], f["norm"], f["attempt"])]
            yield f

    return module.settle(found, b"", common.Scratch(spark), make).collect()


def test_ledger_is_incremental(spark):
    ledger = secrets.fresh_ledger(spark)
    one = table(spark, [(1, "password = hunter22xx", "a"), (2, "AKIA" + "Z" * 12 + " password=short", "a"), (3, "password = hunter22xx", "b")])
    first = {r["doc_id"]: r["_spans"] for r in secrets.scan(one, ledger).collect()}
    assert [(s["kind"], s["start"], s["end"]) for s in first[1]] == [("assign", 0, 21)] and first[3] == first[1] and [s["kind"] for s in first[2]] == ["access"]
    seen = spark.read.parquet(ledger).count()
    assert seen == 2 * 3
    secrets.update(one.unionByName(table(spark, [(4, "new \u0001 text " + "0a" * 16, "a")])), ledger)
    assert spark.read.parquet(ledger).count() == seen + 3
    rules = [*secrets.RULES[:2], ("hex", 2, "[0-9a-f]{40,}", 0, 40)]
    secrets.update(one, ledger, rules=rules)
    assert spark.read.parquet(ledger).count() == seen + 3 + 2
    late = secrets.findings(table(spark, [(4, "new \u0001 text " + "0a" * 16, "a")]), ledger).first()
    assert [(s["start"], s["end"]) for s in late["_spans"]] == [(11, 43)]
    clean = secrets.findings(one, ledger).select("doc_id", secrets.redact(F.col("text"), F.col("_spans")).alias("t")).collect()
    assert {r["doc_id"]: r["t"] for r in clean}[1] == "[secret]"


def test_findings_beside_columns_of_their_names(spark):
    docs = table(spark, [(1, "password = hunter22xx", "a"), (2, None, "a")]).selectExpr("*", "5 as _blob", "6 as _spans", "7 as row", "8 as s")
    found = secrets.scan(docs, secrets.fresh_ledger(spark)).collect()
    assert sorted((r["doc_id"], r["row"], len(r["_spans"] or [])) for r in found) == [(1, 7, 1), (2, 7, 0)]
    ledger = secrets.fresh_ledger(spark)
    secrets.update(docs, ledger)
    assert sorted((r["row"]["doc_id"], r["row"]["_blob"], r["row"]["_spans"]) for r in secrets.paths(docs, ledger).collect()) == [(1, 5, 6), (2, 5, 6)]


def brute_words(texts, width=13):
    least = {}
    for i, t in texts:
        w = t.split()
        for k in range(len(w) - width + 1):
            g = tuple(w[k:k + width])
            least[g] = min(least.get(g, i), i)
    out = {}
    for i, t in texts:
        w = t.split()
        gone = {j for k in range(len(w) - width + 1) if least[tuple(w[k:k + width])] < i for j in range(k, k + width)}
        out[i] = (len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest())
    return out


def test_substring_matches_brute_force(spark):
    rng = random.Random(6)
    passage, texts = lines(rng, 40), []
    for i in range(120):
        t = lines(rng, rng.randint(0, 60), "xyz")
        texts.append((i, t + (" " + passage[:rng.randint(20, len(passage))] if i % 2 else "") + " " + lines(rng, rng.randint(0, 20))))
    texts += [(200, "a " * 100), (201, "a " * 14), (202, texts[3][1])]
    got = {r["doc_id"]: tuple(r)[1:] for r in substring.dedup(table(spark, [(i, t, "a") for i, t in texts])).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()}
    assert got == brute_words(texts) and sum(x[1] > 0 for x in got.values()) > 20


def test_two_stage_sorting():
    rng = random.Random(7)
    for _ in range(60):
        data = np.array([rng.randint(1, 3) for _ in range(rng.randint(1, 120))] + [0], np.uint16)
        assert suffix.two_stage(data, 1000).tolist() == sorted(range(len(data)), key=lambda i: data[i:].tolist())


def brute_bytes(texts, width=400):
    count = collections.Counter(t[i:i + width] for t in texts for i in range(len(t) - width + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, int)
        for i in range(len(t) - width + 1):
            if count[t[i:i + width]] > 1:
                gone[i:i + width] = 1
        gone = gone[:len(t)] > 0
        out.append((len(t), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + (gone[:1].sum())), hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("block", [2048, 8, 2])
def test_suffix_matches_brute_force(spark, block):
    rng = random.Random(8)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(460))
    texts = ["a" * 900, "xyz" * 300, "é" * 300, "", "q" * 399, "ab" * 250 + "c" * 300]
    texts += ["".join(rng.choice("ijk ") for _ in range(rng.randint(0, 300))) + passage + "".join(rng.choice("ijk ") for _ in range(rng.randint(0, 300))) for _ in range(40)]
    texts += [texts[10], texts[11][:500]]
    got = sorted(map(tuple, suffix.dedup(table(spark, [(i, t, "a") for i, t in enumerate(texts)]), block=block).collect()))
    assert [g[1:] for g in got] == brute_bytes([t.encode() for t in texts])


@pytest.mark.parametrize("block", [2048, 4])
def test_suffix_of_repeated_rows_and_null_ids(spark, block):
    rng = random.Random(18)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(700))
    texts = [(None, passage), (None, passage), (None, None), (1, passage), (1, passage), (1, passage[:450] + "!"), (2, ""), (3, "x" * 399 + passage[:401])]
    texts += [(10 + k, "".join(rng.choice("ijk ") for _ in range(rng.randint(0, 200))) + passage[rng.randint(0, 250):rng.randint(420, 700)] + str(k)) for k in range(30)]
    docs = table(spark, [(i, t, "a") for i, t in texts for _ in range(3)], extra=True)
    got = sorted((tuple(r) for r in suffix.dedup(docs, block=block).collect()), key=str)
    want = brute_bytes([(t or "").encode() for _, t in texts for _ in range(3)])
    assert got == sorted(((i, *w) for (i, _), w in zip([x for x in texts for _ in range(3)], want)), key=str)


def test_suffix_hands_python_few_texts_at_a_time(spark, monkeypatch):
    name, sizes, anchors = "spark.sql.execution.arrow.maxRecordsPerBatch", [], suffix.anchors
    before = spark.conf.get(name)

    def count(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    def watched(texts, *rest):
        sizes.extend(r.n for r in texts.coalesce(1).mapInArrow(count, "n bigint").collect())
        return anchors(texts, *rest)

    monkeypatch.setattr(suffix, "anchors", watched)
    out = suffix.dedup(table(spark, [(i, f"text {i}", "a") for i in range(1200)]))
    assert out.count() == 1200 and sum(sizes) == 1200 and max(sizes) <= common.BATCH
    assert spark.conf.get(name) == before


def test_suffix_cuts_copies_once(spark):
    rng, made = random.Random(28), []
    text = "".join(rng.choice("abcdefgh ") for _ in range(900))
    for n in (5, 40):
        docs = table(spark, [(None, text, "a")] * n + [(k, text[:k] + "?" * 50, "a") for k in range(420, 800, 40)])
        scratch = common.Scratch(spark)
        texts = docs.selectExpr("coalesce(doc_id, -1) id", "xxhash64(text) key", "text")
        near, _ = suffix.marks(texts, scratch)
        made.append(suffix.cut_out(near.filter("size(wanted) > 0"), suffix.WIDTH).count())
    assert made[0] == made[1] > 0


def brute_join(texts):
    sets = {}
    for i, t in texts:
        w = t.translate({c: c + 32 for c in range(65, 91)}).split()
        sets[i] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i, _ in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = [i for i, _ in texts]
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_join_matches_brute_force(spark):
    rng, texts = random.Random(9), []
    for g in range(6):
        base = lines(rng, 120).split()
        for k in range(25):
            w = list(base)
            for _ in range(rng.randint(0, 6)):
                w[rng.randrange(len(w))] = "edit" + str(rng.randint(0, 3 if g % 2 else 10**6))
            texts.append((len(texts), " ".join(w[:rng.randint(100, 120)])))
    texts += [(900, "one two"), (901, "ONE two"), (902, "two one"), (903, ""), (904, texts[0][1].upper())]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in setjoin.join(table(spark, [(i, t, "a") for i, t in texts])).collect()}
    assert got == brute_join(texts)


def test_toxicity_finds_misspellings(spark):
    rng = random.Random(10)
    bad = ["stupid", "idiot", "pathetic"]
    rows, labels = [], []
    for i in range(2400):
        w = lines(rng, rng.randint(5, 60)).split()
        toxic = i % 4 == 0
        if toxic:
            for _ in range(1 + i % 3):
                w[rng.randrange(len(w))] = rng.choice(bad)
        rows.append((i, " ".join(w), "a"))
        labels.append((i, 1, int(toxic)))
    before, after = lines(rng, 10), lines(rng, 10)
    rows += [(5000, f"{before} idioot {after}", "a"), (5003, f"{before} {after}", "a"), (5001, "", "a"), (5002, None, "a"), (None, "x", "a")]
    docs, known = table(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.classify(docs, known).collect()}
    held = [r for i, r in got.items() if i is not None and i < 2400 and r["held_out"]]
    assert len(held) > 100 and np.mean([r["predicted"] == int(r["doc_id"] % 4 == 0) for r in held]) > 0.9
    assert got[5000]["score"] > got[5003]["score"] and got[5001]["predicted"] == got[5002]["predicted"] == 0 and got[None]["held_out"]
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items() if i is not None)
    assert {r["score"] for r in toxicity.classify(docs, known.filter("toxic = 0")).collect()} == {0.0}


def test_likely_loses_nothing(spark):
    rows, keys = spark.range(5000).withColumnRenamed("id", "k"), spark.range(0, 5000, 7).withColumnRenamed("id", "j")
    got = {r[0] for r in common.likely(rows, "k", keys, "j").collect()}
    assert {*range(0, 5000, 7)} <= got and len(got) < 800


def test_packs_of_any_size_meet_alike(spark, monkeypatch):
    """The same fingerprints of each document, whether a batch is packed at once or slice by slice."""
    rng = random.Random(21)
    docs = table(spark, [(i, lines(rng, 40), "a") for i in range(1200)] + [(1200, None, "a"), (1201, "", "a")]).coalesce(1)

    def entries(held):
        monkeypatch.setattr(exchange, "HELD", held)
        packed = exchange.pack(docs, lambda texts: setjoin.shingles(texts, 5), 4, 5, lower=True).collect()
        out = []
        for r in packed:
            ids = np.repeat(exchange.expand(r["ids"], np.int64), exchange.expand(r["counts"], np.int32))
            out += zip([r["part"]] * len(ids), ids.tolist(), exchange.widen(r["prints"], 5).tolist())
        return len(packed), sorted(out)

    (few, want), (more, got) = entries(1 << 20), entries(1)
    assert got == want and len(want) == 1200 * 36 and more > few


def test_parts_follow_the_counted_fingerprints(spark, monkeypatch):
    """Small parts make more of them; the components stay the same."""
    rng = random.Random(22)
    bodies = [lines(rng, 60) for _ in range(20)]
    docs = table(spark, [(i, bodies[i % 20] + (" tail" if i >= 20 else ""), "a") for i in range(60)])
    want = sorted(map(tuple, setjoin.join(docs).collect()))
    monkeypatch.setattr(exchange, "PER_PART", 300)
    assert exchange.parts_for(3360, 2) == 12 and exchange.parts_for(0, 2) == 2
    assert sorted(map(tuple, setjoin.join(docs).collect())) == want and len({r[2] for r in want}) == 20
