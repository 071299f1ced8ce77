"""Operator 7: quality rules, a table of thresholds compiled into one projection.

Every metric and every rule is a column expression; nothing is shuffled and no user function
runs. Windows of words are compared by a 64-bit hash inside one document.

Defined cases: null text counts as empty (no words, rejected as too short); repeated rows and
ids are judged alike, each on its own; an empty table gives no rows; other columns of the
input are not read by ``measure``, and are kept whatever their names by ``keep``.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motionlake.llm.common import let, words

#: Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "the of and to in that is was for on with be it as are this or from by at "
    "le la de et les des en un une du que dans est pour qui sur pas par au "
    "der die und den von zu das mit sich auf für ist im dem nicht ein eine als "
    "el y a los del se las por con no una su al lo"
).split()

#: (rule, metric, least, most, words from which it holds); None: open end.
RULES = [
    ("length", "n_words", 20, None, 0),
    ("word_length", "mean_word", 2.0, 20.0, 0),
    ("symbols", "symbol_ratio", None, 0.1, 0),
    ("shouting", "exclaim_ratio", None, 0.3, 0),
    ("stop_words", "stop_ratio", 0.005, None, 200),
    ("lines", "dup_line_ratio", None, 0.5, 0),
    ("stutter", "stutter_ratio", None, 0.3, 0),
]

SYMBOLS = r"[#*$%&|<>]"


def repeated_words(w: Column, width: int = 8) -> Column:
    """Words inside windows of ``width`` words that occur twice or more in the array."""
    def of(hashes: Column) -> Column:
        def places(pairs: Column) -> Column:
            twice = F.filter(pairs, lambda x, k: (F.get(pairs, k - 1)["h"] == x["h"]) | (F.get(pairs, k + 1)["h"] == x["h"]))
            return let(F.array_sort(F.transform(twice, lambda x: x["i"])), lambda s: F.when(F.size(s) < 2, F.lit(0)).otherwise(
                F.aggregate(F.sequence(F.lit(1), F.size(s) - 1), F.lit(width), lambda acc, k: acc + F.least(F.lit(width), F.get(s, k) - F.get(s, k - 1)))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(
            let(F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), places))
    return F.when(F.size(w) <= width, F.lit(0)).otherwise(
        let(F.transform(F.sequence(F.lit(1), F.size(w) - width + 1), lambda i: F.xxhash64(F.slice(w, i, width))), of))


def metrics(text: Column) -> Column:
    """All counts of one text as a struct, each part of the text taken apart once."""
    def of_words(t: Column, w: Column) -> Column:
        def of_lines(lines: Column) -> Column:
            return F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                F.regexp_count(t, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
                F.regexp_count(t, F.lit("!")).cast("long").alias("n_exclaim"),
                F.size(lines).cast("long").alias("n_lines"),
                (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
                repeated_words(w).cast("long").alias("n_repeat_words"),
                F.size(F.filter(w, lambda x: F.lower(x).isin(*dict.fromkeys(STOP_WORDS)))).cast("long").alias("n_stop"),
                F.size(F.filter(w, lambda x, i: (i > 0) & (F.get(w, i - 1) == x))).cast("long").alias("n_stutter"))
        return let(F.filter(F.split(t, "\n"), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]"))), of_lines)
    return let(F.coalesce(text, F.lit("")), lambda t: let(words(t), lambda w: of_words(t, w)))


#: Ratios the rules name, from the counts.
RATIOS = {
    "mean_word": ("word_chars", "n_words"), "symbol_ratio": ("n_symbols", "n_words"), "exclaim_ratio": ("n_exclaim", "n_words"),
    "stop_ratio": ("n_stop", "n_words"), "dup_line_ratio": ("n_dup_lines", "n_lines"), "stutter_ratio": ("n_stutter", "n_words"),
}


def verdict(m: Column, rules=RULES) -> Column:
    """Whether every rule of the table holds, compiled to one condition."""
    out = F.lit(True)
    for _, metric, least, most, since in rules:
        if metric in RATIOS:
            a, b = RATIOS[metric]
            value = m[a] / F.greatest(m[b], F.lit(1))
        else:
            value = m[metric]
        holds = F.lit(True)
        if least is not None:
            holds = holds & (value >= least)
        if most is not None:
            holds = holds & (value <= most)
        out = out & (holds | (m["n_words"] < since) if since else holds)
    return out


def judged(text: Column, rules=RULES) -> Column:
    """Counts, ``base_failed`` and ``kept`` of one text as a struct."""
    def of(m: Column) -> Column:
        failed = (m["n_words"] < 20) | (m["n_repeat_words"] * 100 > m["n_words"] * 30)
        names = ["n_words", "word_chars", "n_symbols", "n_exclaim", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop", "n_stutter"]
        return F.struct(*[m[n].alias(n) for n in names], failed.alias("base_failed"), (~failed & verdict(m, rules)).alias("kept"))
    return let(metrics(text), of)


def measure(docs: DataFrame, rules=RULES) -> DataFrame:
    """Per document: doc_id, the counts, base_failed, kept."""
    return docs.select("doc_id", judged(F.col("text"), rules).alias("_m")).select("doc_id", "_m.*")


def keep(docs: DataFrame, rules=RULES) -> DataFrame:
    """The documents that no rule rejects."""
    return docs.filter(judged(F.col("text"), rules)["kept"])
