"""Personal data: patterns, gazetteers and context vote on candidate spans; EM weighs the votes and trains a span classifier.

Everything on the main path is DataFrame functions. Candidates are the matches of the base patterns, whether or not they
pass their checks, and of one wider phone pattern. Labelling functions vote +1, -1 or 0 on each. Only the counts of vote
patterns (at most 5 x 3^4 rows, whatever the input) come to the driver, where expectation-maximisation estimates how
reliable each labeller is; a logistic classifier is then fitted to the posteriors and applied as a Column expression.
Base spans always stay; other candidates are added where the classifier gives at least ``accept``.

Defined results: a null text is an empty one and has no spans; repeated rows each get their result; an empty table gives an
empty one; positions are code points; of two spans at one place the kind listed first comes first; other columns of the
input are kept by ``mask`` and ignored by ``find``, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fixwave.llm.common import Scratch, let, running

KINDS = ("email", "ip", "card", "phone")
#: Java patterns with the matches of the plain ones. A run of local-part characters is tried once, at its start or where the
#: last match ended, and quantifiers are possessive, so that no text takes more than linear time or deep recursion.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}+",  # shorter runs fail the check on digits anyway
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WIDER = {"phone": r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])"}
#: A cheap test that a text can match at all.
NEEDS = {"email": "@", "phone": "+"}
OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"
#: Gazetteers and context words of the labelling functions.
KNOWN = {
    "email": r"(?i)\.(?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu)$",
    "ip": r"^(?!0|127\.|255\.|22[4-9]\.|23[0-9]\.)",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))",
    "phone": r"^(?:\+(?:1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])|\(?[2-9])",
}
CONTEXT = {
    "email": r"(?i)mail|contact|write|from|to:|kontakt|correo|courriel",
    "ip": r"(?i)\bip\b|addr|host|server|ping|client|adresse",
    "card": r"(?i)card|visa|master|amex|credit|karte|tarjeta|carte|pay",
    "phone": r"(?i)phone|call|tel\b|tel[:.]|fax|mobile|contact|ruf|llam|appel",
}
PLACEHOLDER = r"^[^0-9A-Za-z]*+([0-9A-Za-z])(?:[^0-9A-Za-z]*+\1)*+[^0-9A-Za-z]*+$|(?i)noreply|^(?:0++\.)++0++$"
SHAPE = {
    "email": r"^[A-Za-z][A-Za-z0-9._%+-]{1,30}@",
    "ip": r"^(?:[1-9][0-9]{0,2}\.){3}[0-9]{1,3}$",
    "card": r"^(?:[0-9]{15,16}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4})$",
    "phone": r"^\+?[0-9]{0,3}[ .-]?\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}$",
}
VOTES = ("v_rule", "v_known", "v_context", "v_shape")
SPAN = "kind:int,start:long,stop:long,base:boolean," + ",".join(f"{v}:int" for v in VOTES)


def _matches(text: Column, pattern: str) -> Column:
    """Each match with its place: the texts between matches and the matches themselves add up to every position."""
    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("gaps"))

    def pair(m, g):
        return F.struct(m.alias("value"), F.right(g, F.lit(32)).alias("before"), F.length(g).cast("bigint").alias("gap"), F.length(m).cast("bigint").alias("size"))

    def place(x, at):
        start = at + x["gap"]
        return F.struct(x["value"].alias("value"), x["before"].alias("before"), start.alias("start"), (start + x["size"]).alias("stop"))

    pairs = lambda z: F.zip_with(z["found"], F.slice(z["gaps"], 1, F.size(z["found"])), pair)
    placed = lambda p: F.zip_with(p, running(F.transform(p, lambda x: x["gap"] + x["size"]), lambda a, x: a + x, 0), place)
    return let(both, lambda z: let(pairs(z), placed))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def step(acc, i):
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        doubled = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return acc + F.when(i % 2 == 1, doubled).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), step) % 10 == 0


def _passes(kind: str, value: Column) -> Column:
    digits = _digits(value)
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return value.rlike(OCTETS)
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(False)
    return F.length(digits).between(9, 15)


def _voted(kind: str, n: int, wide: bool):
    """Turns a match of a kind into a candidate with the labellers' votes."""

    def flag(yes, no):
        return F.when(yes, 1).when(no, -1).otherwise(0)

    def span(x):
        value = x["value"]
        passes = F.lit(False) if wide else _passes(kind, value)
        return F.struct(
            F.lit(n).alias("kind"), x["start"].alias("start"), x["stop"].alias("stop"), passes.alias("base"),
            (F.lit(0) if wide else flag(passes, ~passes)).alias("v_rule"),
            flag(value.rlike(KNOWN[kind]), ~value.rlike(KNOWN[kind])).alias("v_known"),
            flag(x["before"].rlike(CONTEXT[kind]), F.lit(False)).alias("v_context"),
            F.when(value.rlike(PLACEHOLDER), -1).when(value.rlike(SHAPE[kind]), 1).otherwise(0).alias("v_shape"),
        )

    return span


def candidates(text: Column) -> Column:
    """An array of candidate spans of a text: kind, place, whether it is a base span, and the labellers' votes."""
    text = F.coalesce(text, F.lit(""))
    arrays = []
    for n, kind in enumerate(KINDS):
        for wide, pattern in ((False, PATTERNS[kind]), *[(True, WIDER[k]) for k in WIDER if k == kind]):
            found = F.transform(_matches(text, pattern), _voted(kind, n, wide))
            none = F.array().cast(f"array<struct<{SPAN}>>")
            can = F.contains(text, F.lit(NEEDS[kind])) if kind in NEEDS and not wide else text.rlike(r"[0-9][ ().-]?[0-9]" if not wide else r"[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}")
            arrays.append(F.when(can, found).otherwise(none))
    return F.concat(*arrays)


def fit(spans: DataFrame, rounds: int = 50) -> Column:
    """From a frame with an array column ``spans``: the probability that a span ``s`` is personal data, as a function.

    Counts of vote patterns are aggregated by Spark; the fit works on those counts alone.
    """
    keys = ["kind", "base", *VOTES]
    rows = spans.select(F.explode("spans").alias("s")).groupBy(*[F.col(f"s.{k}").alias(k) for k in keys]).count().collect()
    rows = sorted(rows, key=lambda r: [int(r[k]) for k in keys])
    # Dawid and Skene: what each labeller of each kind votes on true and on false candidates
    prior = dict.fromkeys(range(len(KINDS)), 0.7)
    like = {(k, v, y, x): (0.6 if x == y else 0.2) for k in range(len(KINDS)) for v in VOTES for y in (1, -1) for x in (1, 0, -1)}
    post = [0.5] * len(rows)
    for _ in range(rounds):
        for i, r in enumerate(rows):
            yes, no = math.log(prior[r["kind"]]), math.log(1 - prior[r["kind"]])
            for v in VOTES:
                yes += math.log(like[r["kind"], v, 1, r[v]])
                no += math.log(like[r["kind"], v, -1, r[v]])
            post[i] = 1 / (1 + math.exp(min(700, max(-700, no - yes))))
        for k in range(len(KINDS)):
            mine = [(r, p) for r, p in zip(rows, post) if r["kind"] == k]
            total = sum(r["count"] for r, _ in mine)
            prior[k] = (sum(p * r["count"] for r, p in mine) + 7) / (total + 10)
            for v in VOTES:
                for y in (1, -1):
                    weight = {x: 2.0 * (3 if x == y else 1) for x in (1, 0, -1)}
                    for r, p in mine:
                        weight[r[v]] += r["count"] * (p if y == 1 else 1 - p)
                    for x in weight:
                        like[k, v, y, x] = weight[x] / sum(weight.values())
    # the final classifier: a logistic model of kind and votes, fitted to the posteriors
    names = [f"k{k}" for k in range(len(KINDS))] + [f"{v}{x}" for v in VOTES for x in (1, -1)]
    on = [[f"k{r['kind']}", *[f"{v}{r[v]}" for v in VOTES if r[v]]] for r in rows]
    weights = dict.fromkeys(names, 0.0)
    mass = sum(r["count"] for r in rows) or 1
    for _ in range(400):
        slope = {n: -1e-3 * weights[n] for n in names}
        for r, p, f in zip(rows, post, on):
            error = (p - 1 / (1 + math.exp(-max(-30, min(30, sum(weights[n] for n in f)))))) * r["count"] / mass
            for n in f:
                slope[n] += error
        for n in names:
            weights[n] += 1.0 * slope[n]

    def probability(s: Column) -> Column:
        logit = F.lit(0.0)
        for k in range(len(KINDS)):
            logit += F.when(s["kind"] == k, weights[f"k{k}"]).otherwise(0.0)
        for v in VOTES:
            logit += F.when(s[v] == 1, weights[f"{v}1"]).when(s[v] == -1, weights[f"{v}-1"]).otherwise(0.0)
        return 1 / (1 + F.exp(-logit))

    return probability


def _kept(spans: Column, probability, accept: float) -> Column:
    """Base spans, and added ones that the classifier accepts and that overlap no base span; in order of start, then kind."""
    far = 1 << 62
    good = F.filter(spans, lambda s: s["base"] | (probability(s) >= accept))
    order = F.sort_array(F.transform(good, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop"), s["base"].alias("base"))))
    most = lambda a, x: F.greatest(a, x)
    # how far base spans before a span reach, and (negated) where the next base span after it starts
    reach = lambda ss: running(F.transform(ss, lambda s: F.when(s["base"], s["stop"]).otherwise(0)), most, 0)
    ahead = lambda ss: F.reverse(running(F.reverse(F.transform(ss, lambda s: F.when(s["base"], -s["start"]).otherwise(-far))), most, -far))
    pair = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    clear = lambda x: x["a"]["base"] | ((x["b"]["a"] <= x["a"]["start"]) & (-x["b"]["b"] >= x["a"]["stop"]))
    return let(order, lambda ss: F.transform(F.filter(F.zip_with(ss, F.zip_with(reach(ss), ahead(ss), pair), pair), clear), lambda x: x["a"]))


def _masked(text: Column, spans: Column, names: tuple) -> Column:
    """The text with each span (in order of start) replaced by its name; what overlaps the one before goes with it.

    Places are looked up in blocks of the text, as counting to a place from the start of a long text for each span would take
    quadratic time.
    """
    block = 1024
    name = F.array(*map(F.lit, names))
    reach = lambda ss: running(F.transform(ss, lambda s: s["stop"]), lambda a, x: F.greatest(a, x), 0)
    part = lambda s, at: F.struct(at.alias("at"), s["start"].alias("to"), s["kind"].alias("kind"))

    def cut(blocks, at, to):
        first = F.floor(at / block).cast("int")
        some = F.array_join(F.slice(blocks, first + 1, F.floor(to / block).cast("int") - first + 1), "")
        return F.substring(some, (at % block + 1).cast("int"), (to - at).cast("int"))

    def joined(blocks, ss):
        parts = F.filter(F.zip_with(ss, reach(ss), part), lambda p: p["to"] >= p["at"])
        end = F.array_max(F.transform(ss, lambda s: s["stop"]))
        return F.concat(F.array_join(F.transform(parts, lambda p: F.concat(cut(blocks, p["at"], p["to"]), F.element_at(name, p["kind"] + 1))), ""), cut(blocks, end, F.length(text).cast("bigint")))

    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{block}}}"), F.lit(0))
    return let(F.struct(blocks.alias("blocks"), spans.alias("spans")), lambda z: let(z["blocks"], lambda bs: let(z["spans"], lambda ss: joined(bs, ss))))


def find(docs: DataFrame, accept: float = 0.9) -> DataFrame:
    """(doc_id, spans): an array of (start, kind as an index of KINDS, stop, base) for each document."""
    found = Scratch(docs.sparkSession, "pii").save(docs.select("doc_id", candidates(docs["text"]).alias("spans")), "spans")
    return found.select("doc_id", _kept(F.col("spans"), fit(found), accept).alias("spans"))


def mask(docs: DataFrame, accept: float = 0.9) -> DataFrame:
    """The same rows and columns, with each span of the text replaced by its kind in brackets, and n_chars, if any, recounted."""
    both = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("d"), candidates(docs["text"]).alias("spans"))
    both = Scratch(docs.sparkSession, "pii").save(both, "masked")
    text, spans = F.col("d.text"), _kept(F.col("spans"), fit(both), accept)
    names = tuple(f"[{k.upper()}]" for k in KINDS)
    masked = let(spans, lambda ss: F.when(F.size(ss) > 0, _masked(text, ss, names)).otherwise(text))
    out = both.withColumn("__t", masked)
    return out.select(*[F.col("__t").alias(c) if c == "text" else F.length("__t").cast("long").alias(c) if c == "n_chars" else F.col("d").getField(c).alias(c) for c in docs.columns])


def _is(kind: int):
    return lambda s: s["kind"] == kind


def digest(found: DataFrame) -> DataFrame:
    """Counts, a hash of the base spans, and all spans as text."""
    name = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)
    text = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["stop"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["base"])
    counts = [F.size(F.filter(base, _is(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
