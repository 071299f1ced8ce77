"""Operator 4: keyed, type-consistent surrogates for personal data.

An entity is a kind and a normal form (lower case, digits only), so all its spellings in all
documents have one surrogate, made from a keyed hash of it: letters stay letters, digits
digits, separators and case stay, a card number keeps its first digit and a check digit that
holds, an address keeps its octet lengths, a telephone number its country code, a mail
address its last domain label, a name its script and length class.

A name is found after a title, and in the rest of that document also without one. It is one entity
in all documents whatever the title; its surrogate has the gender that its titles tell, if all
that tell one agree, and a neutral ending otherwise.

A card is 13 to 19 digits whose check digit holds, ungrouped or grouped as cards are; one in ten
ordinary numbers of that form passes by chance.

Collisions are checked over the corpus: if two entities of a kind get one surrogate, or a
surrogate is an entity of the corpus itself, all but the first by hash move to the next
attempt, until none is left. Later attempts leave the form of the entity, so that this ends also
where a form has fewer free surrogates than entities: octets of any length, a letter, digit or
syllable more each time. Addresses have 254^4 surrogates, enough for 2 * 10^9 different ones. Entities that moved and names with a gender travel to their documents
by a join; all others are computed where the text is read, so no text is shuffled unless there are
such.

Defined cases: null text stays null, empty text empty; rows that share an id are told apart by
their text; repeated rows are replaced alike; an empty table gives no rows; other columns are
not read.
"""

import hashlib
import hmac
import re
from bisect import bisect

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motionlake.llm.common import Scratch

#: Titles before a name, with the gender they tell.
TITLES = {
    "Mr": "m", "Mister": "m", "Herr": "m", "Monsieur": "m", "Señor": "m", "Sr": "m", "Don": "m", "Г-н": "m", "Господин": "m", "Κύριος": "m",
    "Mrs": "f", "Ms": "f", "Miss": "f", "Frau": "f", "Madame": "f", "Mme": "f", "Señora": "f", "Sra": "f", "Doña": "f", "Г-жа": "f", "Госпожа": "f", "Κυρία": "f",
    "Dr": "n", "Prof": "n",
}

#: Syllables and endings of made-up names, by script and gender.
SYLLABLES = {
    "latin": "ba be da do fa fe ga go ha ka la le lo ma me mi na no pa ra re ro sa se ta te ti va vo za".split(),
    "cyrillic": "ба бе да до фа га го ка ла ле ло ма ме ми на но па ра ре ро са се та те ти ва во за".split(),
    "greek": "βα βε δα δο φα γα γο κα λα λε λο μα με μι να νο πα ρα ρε ρο σα σε τα τε τι ζα".split(),
}
ENDINGS = {
    ("latin", "m"): ["n", "r", "s", "rd"], ("latin", "f"): ["na", "lia", "ra", "tte"], ("latin", "n"): ["l", "m", "x"],
    ("cyrillic", "m"): ["н", "р", "л"], ("cyrillic", "f"): ["на", "ра", "лия"], ("cyrillic", "n"): ["м", "л"],
    ("greek", "m"): ["ς", "νος"], ("greek", "f"): ["να", "ρα"], ("greek", "n"): ["λ", "ν"],
}

_WORD = r"[^\W\d_][^\W\d_'’-]+"
#: Groupings of a card number, with one separator throughout: 4-4-4-4 and longer, 4-6-5, 4-6-4, 4-4-4-1 to 3, none.
_CARDS = [r"\d{4}([ -])\d{4}\2\d{4}\2\d{4}\2\d{1,3}", r"\d{4}([ -])\d{4}\2\d{4}\2\d{4}", r"\d{4}([ -])\d{6}\2\d{4,5}", r"\d{4}([ -])\d{4}\2\d{4}\2\d{1,3}", r"\d{13,19}"]

PATTERNS = [
    ("email", re.compile(r"(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")),
    ("ip", re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d|\w)")),
    ("phone", re.compile(r"(?<![\w.])\+\d{1,3}(?=[ .(-])(?:[ .-]?\(?\d{2,4}\)?){2,5}(?!\w)|(?<![\w.+-])\+[1-9]\d{7,14}(?!\w)|(?<![\w.+-])\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}(?![\w-])")),
    *(("card", re.compile(r"(?<![\w.+-])(?=(" + shape + r")(?![\w-]))")) for shape in _CARDS),
    ("ssn", re.compile(r"(?<![\w.+-])\d{3}-\d{2}-\d{4}(?![\w-])")),
    ("name", re.compile(r"\b(" + "|".join(sorted(TITLES, key=len, reverse=True)) + r")\.?[ ](" + _WORD + r"(?:[ ]" + _WORD + r")?)")),
]
_MENTION = re.compile(r"\b[^\W\d_]{2,}\b")
#: Country codes of one and two digits; all others have three.
_CODE = re.compile(r"\+([17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})")
KINDS = list(dict.fromkeys(kind for kind, _ in PATTERNS))
_MAYBE = re.compile(r"[@\d]|\b(?:" + "|".join(sorted(TITLES, key=len, reverse=True)) + r")\b")


def luhn(digits: str) -> bool:
    total = sum(sum(divmod(2 * int(d), 10)) if k % 2 else int(d) for k, d in enumerate(reversed(digits)))
    return total % 10 == 0


def script_of(word: str) -> str:
    return "cyrillic" if "Ѐ" <= word[0] <= "ӿ" else "greek" if "Ͱ" <= word[0] <= "Ͽ" else "latin"


def entities(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, normal form), in order and apart; earlier kinds win.

    The form of a name begins with the gender its title tells. Names found after a title are then
    also found without one, in the rest of the text.
    """
    if not text or not _MAYBE.search(text):
        return []
    taken, out = [], []

    def take(x: tuple[int, int, str, str]) -> None:
        at = bisect(taken, x[:2])
        if (at == len(taken) or x[1] <= taken[at][0]) and (not at or taken[at - 1][1] <= x[0]):
            taken.insert(at, x[:2])
            out.append(x)

    for kind, pattern in PATTERNS:
        if kind == "email" and "@" not in text:
            continue
        for m in pattern.finditer(text):
            start, end = m.span({"name": 2, "card": 1}.get(kind, 0))
            surface = text[start:end]
            if kind == "card" and not luhn(re.sub(r"\D", "", surface)):
                continue
            if kind == "name":
                # words that begin in lower case are not part of a name
                words = [w for w in surface.split(" ")]
                words = words[:1 if len(words) > 1 and not words[1][0].isupper() else 2]
                if not words[0][0].isupper():
                    continue
                end = start + len(" ".join(words))
                found = [(start, start + len(words[0]), "name")] + ([(end - len(words[1]), end, "name")] if len(words) > 1 else [])
                found = [(a, b, kind, f"{TITLES[m.group(1)]}:{script_of(text[a])}:{text[a:b].casefold()}") for a, b, _ in found]
            elif kind == "email":
                found = [(start, end, kind, surface.lower())]
            elif kind == "ip":
                found = [(start, end, kind, surface)]
            else:
                digits = re.sub(r"\D", "", surface)
                code = re.match(r"\+(\d{1,3})(?=\D)", surface) or _CODE.match(surface)
                found = [(start, end, kind, f"{code.group(1) if code else ''}:{digits[len(code.group(1)) if code else 0:]}")]
            for x in found:
                take(x)
    named = {text[a:b].casefold() for a, b, kind, _ in out if kind == "name"}
    for m in _MENTION.finditer(text) if named else ():
        if m.group()[0].isupper() and m.group().casefold() in named:
            take((*m.span(), "name", f"n:{script_of(m.group())}:{m.group().casefold()}"))
    return sorted(out)


def ungendered(kind: str, norm: str) -> str:
    return norm.split(":", 1)[1] if kind == "name" else norm


#: Attempts within the form of an entity; later ones may be longer, so that no class is ever full.
WIDER = 3


class Stream:
    """Numbers from a keyed hash of an entity and an attempt."""

    def __init__(self, key: bytes, *parts):
        self.key, self.parts, self.held, self.block = key, "\u0000".join(map(str, parts)).encode(), b"", 0

    def below(self, n: int) -> int:
        if len(self.held) < 4:
            self.held += hmac.new(self.key, self.parts + self.block.to_bytes(4, "big"), hashlib.sha256).digest()
            self.block += 1
        value, self.held = int.from_bytes(self.held[:4], "big"), self.held[4:]
        return value % n


def alike(text: str, stream: Stream) -> str:
    """Letters for letters, digits for digits, the rest as it is."""
    return "".join(chr(97 + stream.below(26)) if c.isalpha() else str(stream.below(10)) if c.isdigit() else c for c in text)


def surrogate(kind: str, norm: str, attempt: int, key: bytes) -> str:
    """The normal form of the surrogate of an entity, for a name without its gender."""
    s = Stream(key, kind, norm, attempt)
    if kind == "email":
        local, domain = norm.rsplit("@", 1)
        host, last = domain.rsplit(".", 1)
        return f"{alike(local + 'x' * max(0, attempt - WIDER), s)}@{alike(host, Stream(key, 'domain', domain))}.{last}"
    if kind == "ip":
        if attempt > WIDER:
            return ".".join(str(1 + s.below(254)) for _ in range(4))
        low = {1: (1, 9), 2: (10, 99), 3: (100, 254)}
        return ".".join(str(low[len(o)][0] + s.below(low[len(o)][1] - low[len(o)][0] + 1)) for o in norm.split("."))
    if kind == "name":
        gender, script, word = norm.split(":", 2)
        syllables = [SYLLABLES[script][s.below(len(SYLLABLES[script]))] for _ in range(max(2, min(4, len(word) // 2)) + max(0, attempt - WIDER))]
        ends = ENDINGS[script, gender]
        return f"{script}:{''.join(syllables)}{ends[s.below(len(ends))]}"
    code, digits = norm.split(":", 1)
    out = str(1 + s.below(9)) if kind != "card" else digits[0]
    out += "".join(str(s.below(10)) for _ in range(len(digits) - 1 + max(0, attempt - 2 * WIDER)))
    if kind == "card":
        out = next(out[:-1] + str(k) for k in range(10) if luhn(out[:-1] + str(k)))
    return f"{code}:{out}"


def rendered(surface: str, kind: str, new: str) -> str:
    """The surrogate in the spelling of the place it goes to."""
    if kind == "name":
        word = new.split(":", 1)[1]
        return word.upper() if surface.isupper() else word.capitalize()
    if kind in ("email", "ip"):
        return "".join(n.upper() if c.isupper() else n for c, n in zip(surface, new)) if len(surface) == len(new) else new
    digits = iter(new.replace(":", ""))
    return "".join([*(next(digits) if c.isdigit() else c for c in surface), *digits])


ENTITY = "kind string, norm string, attempt int, new string"


def bare(norm: str) -> Column:
    """``ungendered`` as a column."""
    return F.when(F.col("kind") == "name", F.expr(f"substring({norm}, 3)")).otherwise(F.col(norm))


def settle(found: DataFrame, key: bytes, scratch: Scratch, maker=None) -> DataFrame:
    """ENTITY rows whose surrogates are distinct per kind and no entity themselves, from (kind, norm). Runs jobs."""
    def make(frames):
        for f in frames:
            f["new"] = [surrogate(k, n, a, key) for k, n, a in zip(f["kind"], f["norm"], f["attempt"])]
            yield f

    make = maker or make
    real = scratch.keep(found.distinct())
    made = scratch.keep(real.withColumn("attempt", F.lit(0)).mapInPandas(make, ENTITY))
    while True:
        owner = made.groupBy("kind", F.col("new").alias("_new")).agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct(F.col("attempt") * -1, F.xxhash64("norm"), "norm")).alias("_first"))
        owner = owner.join(real.select(F.col("kind").alias("_k"), bare("norm").alias("_real")), (F.col("kind") == F.col("_k")) & (F.col("_new") == F.col("_real")), "left")
        clash = owner.filter("_n > 1 or _real is not null").select("kind", F.col("_new").alias("new"), F.when(F.col("_real").isNull(), F.col("_first.norm")).alias("_stays"))
        moved = scratch.keep(made.join(clash, ["kind", "new"]).filter(~F.col("norm").eqNullSafe(F.col("_stays"))).select("kind", "norm", F.col("attempt") + 1))
        if moved.isEmpty():
            return made
        again = moved.toDF("kind", "norm", "attempt").mapInPandas(make, ENTITY)
        made = scratch.keep(made.join(moved.select("kind", "norm"), ["kind", "norm"], "left_anti").unionByName(again))


COUNTS = [f"n_{k}" for k in KINDS]


def replace(rows: DataFrame, key: bytes) -> DataFrame:
    """doc_id, counts per kind and the text with surrogates, from (doc_id, text, moved)."""
    def run(frames):
        for f in frames:
            texts, counts = [], []
            for text, moved in zip(f["text"], f["moved"]):
                told = {(m["kind"], m["norm"]): (m["entity"], m["attempt"]) for m in moved} if moved is not None else {}
                out, at, n = [], 0, dict.fromkeys(KINDS, 0)
                for start, end, kind, norm in entities(text):
                    norm = ungendered(kind, norm)
                    entity, attempt = told.get((kind, norm), (f"n:{norm}" if kind == "name" else norm, 0))
                    out += [text[at:start], rendered(text[start:end], kind, surrogate(kind, entity, attempt, key))]
                    at, n[kind] = end, n[kind] + 1
                texts.append("".join([*out, text[at:]]) if out else text)
                counts.append([n[k] for k in KINDS])
            made = pd.DataFrame(counts, columns=COUNTS)
            made.insert(0, "doc_id", f["doc_id"].astype("Int64").to_numpy(dtype=object, na_value=None))
            made["text"] = texts
            yield made

    return rows.select("doc_id", "text", "moved").mapInPandas(run, "doc_id bigint, " + ", ".join(f"{c} bigint" for c in COUNTS) + ", text string")


def pseudonymise(docs: DataFrame, key: bytes = b"surrogates") -> DataFrame:
    """Per document: doc_id, counts per kind, text. Runs jobs."""
    scratch = Scratch(docs.sparkSession)
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def detect(frames):
        for f in frames:
            rows = [(d, h, k, n) for d, h, t in zip(f["_id"], f["_h"], f["text"]) for k, n in sorted({x[2:] for x in entities(t)})]
            yield pd.DataFrame(rows, columns=["_id", "_h", "kind", "norm"])

    keys = [F.coalesce("doc_id", F.lit(-2**63)).alias("_id"), F.xxhash64("text").alias("_h")]
    found = scratch.keep(named.filter("text is not null").select(*keys, "text").mapInPandas(detect, "_id bigint, _h bigint, kind string, norm string"))
    found = found.withColumn("gender", F.when(F.col("kind") == "name", F.substring("norm", 1, 1))).withColumn("norm", bare("norm"))
    genders = F.collect_set(F.when(F.col("gender") != "n", F.col("gender")))
    real = found.groupBy("kind", "norm").agg(F.when(F.size(genders) == 1, genders[0]).otherwise("n").alias("gender"))
    real = real.select("kind", F.when(F.col("kind") == "name", F.concat_ws(":", "gender", "norm")).otherwise(F.col("norm")).alias("norm"))
    settled = settle(real, key, scratch).filter("attempt > 0 or kind = 'name' and norm not like 'n:%'")
    moved = scratch.keep(settled.select("kind", bare("norm").alias("norm"), F.col("norm").alias("entity"), "attempt"))
    none = "array<struct<kind:string,norm:string,entity:string,attempt:int>>"
    if moved.isEmpty():
        return replace(named.withColumn("moved", F.lit(None).cast(none)), key)
    per = found.join(moved, ["kind", "norm"]).groupBy("_id", "_h").agg(F.collect_set(F.struct("kind", "norm", "entity", "attempt")).alias("moved"))
    return replace(named.select("doc_id", "text", *keys).join(per, ["_id", "_h"], "left"), key)
