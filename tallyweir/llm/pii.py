"""PII: candidate spans from high-recall generators, scored by boosted trees, above calibrated thresholds.

Base rules find email, ip, card and phone spans; these always count. Generators
of wider patterns (spelled-out signs, other separators, national numbers) propose
further spans, which may overlap. Each is described by its format and by the
``CONTEXT`` characters on both sides, scored by gradient-boosted trees of its kind,
and kept above that kind's threshold, the least at which spans of the calibration
texts were nearly all right. Of those, a span that overlaps a base span goes; of
spans that overlap each other the one of the best score stays, then the best of
those that don't overlap it, and so on.

Everything on the main path is built-in functions over one pass without a
shuffle: matches and the gaps between them come from ``regexp_extract_all`` and
``split`` on one pattern, running sums of their lengths give positions in code
points, and the trees are sums of conditions. Running sums go block by block
(``scanned``) and parts of a text are cut from ``pieces`` of it, so a text with
very many spans costs little more than in proportion. Patterns run only on texts
that hold their trigger character. The trees are fitted on the driver to template
texts of a fixed rule, described by the very same expressions; no corpus text and
no label is used.

Defined cases: null and empty texts have no spans; repeated rows are searched
each; other columns pass through ``redacted`` and are ignored by ``digests``.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: Equivalent to the plain rules, but linear on long runs: where a run failed, no later start in it is tried.
#: A chain of digits of 12 to 19 is matched whole; shorter and longer chains can't be cards.
BASE = {
    "email": r"[A-Za-z0-9._%+-](?:(?<=\G.)|(?<![A-Za-z0-9._%+-].))[A-Za-z0-9._%+-]*+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9](?<![0-9].)[0-9]*+(?:\.[0-9]++){3}",
    "card": r"[0-9](?<![0-9].)(?<![0-9][ -].)(?:[ -]?[0-9]){11,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TRIGGER = {"email": "@", "ip": r"[0-9]\.[0-9]+\.", "card": r"[0-9][0-9 -]{10,}[0-9]", "phone": r"\+[0-9]"}
WIDE = {
    "email": r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:@|\(at\)|\[at\]|\{at\}) ?[A-Za-z0-9-]{1,63}+(?: ?(?:\.|\(dot\)|\[dot\]|\{dot\}) ?[A-Za-z0-9-]{1,63}+){1,5}+",
    "ip": r"(?<![0-9.])[0-9]{1,3}+(?:(?:\[\.\]|\(\.\)|\[dot\]|\(dot\)| \. )[0-9]{1,3}+){3}(?![0-9])",
    "card": r"(?<![0-9])[0-9](?:[ ._/‐-–-]{0,2}[0-9]){12,18}+(?![ ._/-]?[0-9])",
    "phone": r"(?<![0-9A-Za-z+.])(?:\(?[0-9]{2,4}\)?[ ./-]{1,2}){1,3}[0-9]{3,4}[ ./-]?[0-9]{3,5}(?![0-9A-Za-z])",
}
WIDE_TRIGGER = {"email": r"(?i)@|[(\[{]at[)\]}]", "ip": r"(?i)[0-9] ?[\[(]?(?:\.|dot)[\])]? ?[0-9]", "card": r"[0-9]", "phone": r"[0-9][ )./-]{1,3}[0-9]"}
CONTEXT = 28
CUES = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|reach|kontakt|courriel|correo)\b",
    "ip": r"(?i)\b(?:ip|host|address|server|adresse|login from|client)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|credit|debit|karte|carte|tarjeta|pan)\b",
    "phone": r"(?i)\b(?:phone|tel|call|mobile|cell|fax|telefon|telefono|ring|sms)\b",
}
AGAINST = r"(?i)\b(?:order|invoice|version|section|isbn|id|no|serial|ref|page|chapter|part|sku|rfc|build|date|total)\b"
UNITS = r"(?i)^ ?(?:EUR|USD|GBP|[$€£%]|kg|km|cm|mm|pages?|items|pieces|pcs|units|words)(?![A-Za-z])"
AFTER = r"(?i)^[ ,;)]{0,3}(?:\((?:mobile|home|work|office|visa|mastercard|private)\)|(?:anytime|please|thanks|expires|exp|cvv|for details|to reach)\b)"
N_FEATURES = 14
SPAN = "array<struct<start:int,rank:int,end:int,match:string,score:double>>"
BLOCK, PIECE = 64, 512


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def scanned(values: Column, zero: Column, add: Callable[[Column, Column], Column]) -> Column:
    """For each place of an array the sum (in the sense of ``add``) of all values before it: of whole blocks, then of a block's own."""

    def total(part: Column, start: Column) -> Column:
        return F.aggregate(part, start, lambda x, y: add(x, y))

    def of(v: Column) -> Column:
        count = F.floor((F.size(v) + (BLOCK - 1)) / BLOCK).cast("int")
        blocks = F.transform(F.slice(F.sequence(F.lit(0), F.greatest(count, F.lit(1))), F.lit(1), count), lambda b: total(F.slice(v, b * BLOCK + 1, F.lit(BLOCK)), zero))
        before = lambda t: F.transform(t, lambda _, b: total(F.slice(t, F.lit(1), b), zero))
        block = lambda i: F.floor(i / BLOCK).cast("int")
        return let(let(blocks, before), lambda t: F.transform(v, lambda _, i: total(F.slice(v, block(i) * BLOCK + 1, i % BLOCK), F.get(t, block(i)))))

    return let(values, of)


def pieces(text: Column) -> Column:
    """A text in pieces of PIECE code points, from which parts are cut without a walk from its start."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def cut(of: Column, start: Column, length: Column) -> Column:
    """``length`` code points from ``start`` on, of a text in pieces."""
    first = F.floor(start / PIECE).cast("int")
    count = F.floor((start + length) / PIECE).cast("int") - first + 1
    return F.substring(F.array_join(F.slice(of, first + 1, count), ""), start - first * PIECE + 1, length)


def matches(text: Column, pattern: str, rank: int) -> Column:
    """Spans of the leftmost non-overlapping matches, positions in code points, end exclusive."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    paired = F.arrays_zip(found.alias("m"), F.slice(gaps, F.lit(1), F.size(found)).alias("g"))
    sized = F.transform(paired, lambda x: F.struct(F.length(x["g"]).alias("g"), F.length(x["m"]).alias("n"), x["m"].alias("m")))

    def spans(v: Column) -> Column:
        begins = scanned(F.transform(v, lambda x: x["g"] + x["n"]), F.lit(0), lambda x, y: x + y)
        return let(begins, lambda t: F.transform(v, lambda x, i: F.struct((F.get(t, i) + x["g"]).alias("start"), F.lit(rank).alias("rank"), (F.get(t, i) + x["g"] + x["n"]).alias("end"), x["m"].alias("match"), F.lit(1.0).alias("score"))))

    return let(sized, spans)


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(match: Column) -> Column:
    plain = digits(match)

    def step(total: Column, i: Column) -> Column:
        d = F.substring(plain, F.length(plain) - i, F.lit(1)).cast("int")
        double = d * 2
        return total + F.when(i % 2 == 1, F.when(double > 9, double - 9).otherwise(double)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(plain) - 1), F.lit(0), step) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return ~F.exists(F.split(match, r"\."), lambda p: ~p.rlike(r"^0*(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return luhn(match)
    if kind == "phone":
        return F.length(digits(match)).between(9, 15)
    return F.lit(True)


def _checked(kind: str) -> Callable[[Column], Column]:
    return lambda s: _valid(kind, s["match"])


def _of_rank(rank: int) -> Callable[[Column], Column]:
    return lambda s: s["rank"] == rank


def base_spans(text: Column) -> Column:
    none = F.expr(f"cast(array() as {SPAN})")
    parts = []
    for rank, kind in enumerate(KINDS):
        likely = F.contains(text, F.lit("@")) if kind == "email" else text.rlike(TRIGGER[kind])
        parts.append(F.when(likely, F.filter(matches(text, BASE[kind], rank), _checked(kind))).otherwise(none))
    return F.array_sort(F.concat(*parts))


def wide_spans(text: Column) -> Column:
    none = F.expr(f"cast(array() as {SPAN})")
    return F.concat(*(F.when(text.rlike(WIDE_TRIGGER[kind]), matches(text, WIDE[kind], rank)).otherwise(none) for rank, kind in enumerate(KINDS)))


def sides(of: Column, span: Column) -> Column:
    """The characters on both sides of a span of a text in pieces."""
    begin = F.greatest(span["start"] - CONTEXT, F.lit(0))
    return F.struct(cut(of, begin, span["start"] - begin).alias("left"), cut(of, span["end"], F.lit(CONTEXT)).alias("right"))


def features(near: Column, span: Column, rank: int) -> list[Column]:
    """The N_FEATURES yes-or-no features of a candidate, by its format and its surroundings."""
    match, kind, left, right = span["match"], KINDS[rank], near["left"], near["right"]
    n = F.length(digits(match))
    own = {
        "email": [match.rlike(r"(?i)(?:com|org|net|edu|gov|io|de|fr|es|uk|eu|info)$"), match.rlike("[(\\[{]"), match.rlike("^[A-Za-z]"), match.rlike(r" (?:@|\.) "), match.rlike(r"\.[A-Za-z]{2,6}$|[)\]}] ?[A-Za-z]{2,6}$")],
        "ip": [~F.exists(F.split(F.regexp_replace(match, "[^0-9]+", "."), r"\."), lambda p: p.cast("int") > 255), match.rlike(r"\["), match.rlike("dot"), match.rlike(r"^0"), match.rlike(" ")],
        "card": [luhn(match), match.rlike("^[3-6]"), n.isin(13, 15, 16), match.rlike(r"^[0-9]{4}([ ._/‐-–-]{1,2})[0-9]{4}\1[0-9]{4}\1[0-9]{4}$"), match.rlike(r"[./]")],
        "phone": [n.between(9, 12), match.rlike(r"^\("), match.rlike(r"^\(?[0-9]{3}\)?[ .-]{1,2}[0-9]{3}[ .-][0-9]{4}$"), match.rlike("/"), match.rlike(r"^(?:19|20)[0-9]{2}[ ./-]|[ ./-](?:19|20)[0-9]{2}$")],
    }[kind]
    around = [left.rlike(CUES[kind]), left.rlike(AGAINST), left.rlike(r"[0-9A-Za-z_#=/]$"), left.rlike(r"[:] ?$"), left.rlike(r"[0-9]")]
    behind = [right.rlike(r"^[0-9A-Za-z_#=/]"), right.rlike(UNITS), right.rlike(AFTER), right.rlike(CUES[kind])]
    return [*own, *around, *behind]


# --- boosted trees on yes-or-no features ---------------------------------------------------

Tree = tuple  # a float, or (feature, tree if no, tree if yes)


def grown(rows: list[tuple[list[bool], float, float]], depth: int, least: int = 4) -> Tree | float:
    """A regression tree on (features, gradient, curvature) with the usual second-order gain."""

    def value(part: list) -> float:
        return sum(r[1] for r in part) / (sum(r[2] for r in part) + 1.0)

    def gain(part: list) -> float:
        return sum(r[1] for r in part) ** 2 / (sum(r[2] for r in part) + 1.0)

    best = (1e-3, None, None, None)
    if depth:
        for f in range(N_FEATURES):
            no, yes = [r for r in rows if not r[0][f]], [r for r in rows if r[0][f]]
            if len(no) >= least and len(yes) >= least and (g := gain(no) + gain(yes) - gain(rows)) > best[0]:
                best = (g, f, no, yes)
    if best[1] is None:
        return value(rows)
    return best[1], grown(best[2], depth - 1, least), grown(best[3], depth - 1, least)


def answer(tree: Tree | float, x: list[bool]) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if x[tree[0]] else tree[1]
    return tree


def boosted(rows: list[tuple[list[bool], int]], rounds: int = 12, rate: float = 0.5, depth: int = 3) -> list:
    trees, margin = [], [0.0] * len(rows)
    for _ in range(rounds):
        p = [1 / (1 + math.exp(-m)) for m in margin]
        trees.append(grown([(x, y - q, q * (1 - q)) for (x, y), q in zip(rows, p, strict=True)], depth))
        margin = [m + rate * answer(trees[-1], x) for m, (x, _) in zip(margin, rows, strict=True)]
    return [(rate, t) for t in trees]


def _scored(trees: list, x: list[bool]) -> float:
    return 1 / (1 + math.exp(-sum(rate * answer(t, x) for rate, t in trees)))


def _as_column(trees: list, x: Column) -> Column:
    """The trees' answer to an array of features."""

    def of(tree: Tree | float) -> Column:
        return F.when(F.get(x, F.lit(tree[0])), of(tree[2])).otherwise(of(tree[1])) if isinstance(tree, tuple) else F.lit(float(tree))

    return 1 / (1 + F.exp(-reduce(lambda a, b: a + b, (rate * of(t) for rate, t in trees))))


def _answering(trees: list) -> Callable[[Column], Column]:
    return lambda x: _as_column(trees, x)


# --- template texts -------------------------------------------------------------------------


def _luhn_number(rng: random.Random, n: int, good: bool) -> str:
    body = [rng.choice("3456"), *(rng.choice("0123456789") for _ in range(n - 2))]
    total = sum(int(d) if i % 2 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(body)))
    check = (10 - total % 10) % 10
    return "".join(body) + str(check if good else (check + rng.randrange(1, 10)) % 10)


def templates(seed: int, per_kind: int = 160) -> list[tuple[int, str, int]]:
    """(rank of the kind, text with one candidate, whether it is personal data)."""
    rng = random.Random(seed)
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randrange(3, 9)))
    cues = {0: ["email", "contact", "mail me"], 1: ["ip", "host", "login from"], 2: ["card", "visa", "credit card"], 3: ["phone", "call", "tel"]}
    against = ["order", "invoice no", "version", "section", "serial", "ref", "page", "build", "isbn"]
    out = []
    for rank in range(4):
        for _ in range(per_kind):
            good = rng.random() < 0.5
            cue = rng.random() < (0.6 if good else 0.1)
            lead = rng.choice(cues[rank]) + rng.choice([" ", ": "]) if cue else rng.choice(against) + " " if not good and rng.random() < 0.6 else f"{word()} "
            if rank == 0:
                at, dot = rng.choice([(" (at) ", " (dot) "), ("[at]", "[dot]"), ("(at)", "."), (" @ ", "."), ("{at}", "{dot}")])
                span = f"{word()}{at}{word()}{dot}{rng.choice(['com', 'org', 'net', 'de'])}" if good else f"{word()}{rng.choice([' @ ', '(at) ', ' [at] '])}{d(2)}{rng.choice(['.', ' . '])}{d(2)}"
            elif rank == 1:
                sep = rng.choice(["[.]", "(.)", "[dot]", "(dot)", " . "])
                parts = [str(rng.randrange(1, 256)) for _ in range(4)] if good else [str(rng.randrange(200, 1000)) for _ in range(4)]
                if not good and all(int(p) <= 255 for p in parts):
                    parts[0] = "700"
                span = sep.join(parts)
            elif rank == 2:
                n = _luhn_number(rng, 16, good)
                sep = rng.choice([".", "_", "/", "  ", "–"]) if good or rng.random() < 0.5 else ""
                span = sep.join(n[i : i + 4] for i in range(0, 16, 4)) if sep else _luhn_number(rng, 17, False)
            else:
                a, b, c = d(3), d(3), d(4)
                shapes = [f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"0{d(3)} {c}{d(2)}", f"0{a}-{b} {c}", f"(0{d(2)}) {d(3)} {c}"]
                span = rng.choice(shapes) if good else rng.choice([f"{rng.randrange(1900, 2030)}-{d(4)}-{d(3)}", f"{d(2)}/{d(2)}/{d(4)}", f"{d(4)} {d(3)}{d(3)}", f"{d(2)}.{d(3)}.{d(3)}"])
                if good and not cue:
                    good = span.startswith("(")
            behind = ""
            if rng.random() < 0.3:
                behind = rng.choice([" (mobile)", " (work)", " please", ", thanks", " expires soon"]) if good else rng.choice([" EUR", " pages", " kg", "%", " items", "_x"])
            out.append((rank, f"{word()} {word()} {lead}{span}{behind} {word()}", int(good)))
    return out


_MODELS: dict[int, list[tuple[list, float]]] = {}


def trained(spark: SparkSession, precision: float = 0.99) -> list[tuple[list, float]]:
    """Trees and threshold of each kind, from some hundred template texts; the same every time."""
    if 0 in _MODELS:
        return _MODELS[0]
    described: dict[tuple[int, int], list[tuple[list[bool], int]]] = {}
    for part, seed in enumerate((3, 4)):
        frame = spark.createDataFrame([(r, t, y) for r, t, y in templates(seed)], "rank int, text string, y int").coalesce(1)
        for rank in range(4):
            span = F.element_at(F.filter(wide_spans(F.col("text")), _of_rank(rank)), -1)
            rows = frame.filter(F.col("rank") == rank).withColumn("s", F.when(F.size(F.filter(wide_spans(F.col("text")), _of_rank(rank))) > 0, span)).filter("s IS NOT NULL")
            got = rows.withColumn("near", sides(pieces(F.col("text")), F.col("s"))).select("y", F.array(*features(F.col("near"), F.col("s"), rank)).alias("x")).collect()
            described[part, rank] = [(list(r.x), r.y) for r in got]
    models = []
    for rank in range(4):
        trees = boosted(described[0, rank])
        held = sorted(((_scored(trees, x), y) for x, y in described[1, rank]), reverse=True)
        threshold, right = 1.01, 0
        for k, (p, y) in enumerate(held, 1):
            right += y
            if right >= precision * k and p >= 0.5 and (k == len(held) or held[k][0] < p):
                threshold = p
        models.append((trees, threshold))
    _MODELS[0] = models
    return models


# --- spans, digests, redaction ---------------------------------------------------------------


def _best(spans: Column) -> Column:
    """Of spans in which each overlaps the one before, the best and those that overlap none better, in order."""
    none = F.expr(f"cast(array() as {SPAN})")
    ranked = F.array_sort(spans, lambda x, y: F.when(x["score"] != y["score"], F.when(x["score"] > y["score"], -1).otherwise(1)).when(x["start"] != y["start"], x["start"] - y["start"]).otherwise(x["rank"] - y["rank"]))
    taken = F.aggregate(ranked, none, lambda kept, s: F.when(F.exists(kept, lambda k: (k["start"] < s["end"]) & (s["start"] < k["end"])), kept).otherwise(F.concat(kept, F.array(s))))
    return F.when(F.size(spans) == 1, spans).otherwise(taken)


def apart(base: Column, added: Column) -> Column:
    """Those of the ``added`` spans (in order) that overlap no base span and no better one, by running extremes over the order."""
    tagged = lambda spans, is_base: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(is_base).alias("base"), s.alias("s")))
    far = F.lit(2_147_483_647)

    def free(both: Column) -> Column:
        reach = scanned(F.transform(both, lambda x: F.when(x["base"], x["s"]["end"]).otherwise(0)), F.lit(0), F.greatest)
        ahead = F.reverse(scanned(F.transform(F.reverse(both), lambda x: F.when(x["base"], x["start"]).otherwise(far)), far, F.least))
        # at equal starts a base span stands after the added one, so each is seen from one side
        kept = let(F.struct(reach.alias("r"), ahead.alias("a")), lambda t: F.filter(both, lambda x, i: ~x["base"] & (F.get(t["r"], i) <= x["start"]) & (F.get(t["a"], i) >= x["s"]["end"])))
        return F.transform(kept, lambda x: x["s"])

    def clustered(spans: Column) -> Column:
        reach = scanned(F.transform(spans, lambda s: s["end"]), F.lit(0), F.greatest)
        firsts = let(reach, lambda r: F.filter(F.transform(spans, lambda s, i: F.when(s["start"] >= F.get(r, i), i)), lambda i: i.isNotNull()))
        return let(firsts, lambda f: F.flatten(F.transform(f, lambda at, k: _best(F.slice(spans, at + 1, F.coalesce(F.get(f, k + 1), F.size(spans)) - at)))))

    order = F.array_sort(F.concat(tagged(added, False), tagged(base, True)))
    none = F.expr(f"cast(array() as {SPAN})")
    return let(let(order, free), lambda spans: F.when(F.size(spans) > 1, clustered(spans)).otherwise(F.coalesce(spans, none)))


def with_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds base and spans: arrays of (start, rank, end, match, score), in order of start and kind; a base span has the score 1."""
    models = trained(docs.sparkSession)
    body = F.coalesce(F.col(text), F.lit(""))
    none = F.expr(f"cast(array() as {SPAN})")
    anything = body.rlike(r"[0-9@]|(?i)[(\[{]at[)\]}]")
    found = docs.withColumn("base", F.when(anything, base_spans(body)).otherwise(none)).withColumn("wide", F.when(anything, wide_spans(body)).otherwise(none))

    def scored(of: Column) -> Column:
        def one(s: Column) -> Column:
            def by_kind(near: Column) -> Column:
                kinds = [let(F.array(*features(near, s, rank)), _answering(trees)) for rank, (trees, _) in enumerate(models)]
                return reduce(lambda a, k: a.when(s["rank"] == k, kinds[k]), range(1, 4), F.when(s["rank"] == 0, kinds[0]))

            return F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["match"].alias("match"), let(sides(of, s), by_kind).alias("score"))

        least = F.array(*(F.lit(float(t)) for _, t in models))
        return F.filter(F.transform("wide", one), lambda s: s["score"] >= F.get(least, s["rank"]))

    kept = found.withColumn("kept", F.when(F.size("wide") > 0, F.array_sort(let(pieces(body), scored))).otherwise(none))
    return kept.withColumn("spans", F.when(F.size("kept") > 0, F.array_sort(F.concat("base", apart(F.col("base"), F.col("kept"))))).otherwise(F.col("base"))).drop("wide", "kept")


def joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, base spans counted by kind, the digest of base spans, and all spans."""
    counts = [F.size(F.filter("base", _of_rank(rank))).cast("long").alias(f"n_{kind}") for rank, kind in enumerate(KINDS)]
    return with_spans(docs.select("doc_id", "text")).select("doc_id", *counts, F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of the text replaced by its kind in brackets; n_chars follows the text."""
    names = F.array(*(F.lit(f"[{kind.upper()}]") for kind in KINDS))
    work = with_spans(docs.select(F.struct(*docs.columns).alias("row"), F.col("text").alias("text")))

    def rebuilt(of: Column) -> Column:
        # spans of two kinds may overlap: the later one adds its mark and only what lies behind it is skipped
        reach = scanned(F.transform("spans", lambda s: s["end"]), F.lit(0), F.greatest)
        marked = let(reach, lambda r: F.transform("spans", lambda s, i: F.concat(cut(of, F.get(r, i), F.greatest(s["start"] - F.get(r, i), F.lit(0))), F.get(names, s["rank"]))))
        end = F.aggregate("spans", F.lit(0), lambda a, s: F.greatest(a, s["end"]))
        return F.concat(F.array_join(marked, ""), let(end, lambda e: cut(of, e, F.length("text") - e)))

    clean = let(pieces(F.col("text")), rebuilt)
    text = F.when(F.size("spans") > 0, clean).otherwise(F.col("text"))
    columns = [F.col("clean").alias(c) if c == "text" else F.when(F.col("changed"), F.length("clean").cast(docs.schema[c].dataType)).otherwise(F.col(f"row.`{c}`")).alias(c) if c == "n_chars" else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    return work.select("row", text.alias("clean"), (F.size("spans") > 0).alias("changed")).select(*columns)
