"""Each operator against a brute-force version, on small tables with every odd case."""

import datetime
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

pytest.importorskip("tallyweir.llm")

from tallyweir.llm import bpe, decontamination, interpolation, near_dedup, pii, quality, quality_rules, sharding, toxicity, url_rules  # noqa: E402
from tallyweir.llm.common import Remembered, read_text  # noqa: E402
from tallyweir.llm.queries import tokenizer_path, url_rule_set  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, node string, shard int, score double, ids string"


def words(rng, n):
    return " ".join(rng.choice(("alpha", "beta", "Gamma", "delta", "eps", "zeta", "eta", "theta", "é", "x1")) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    """Ids and texts: nulls, empty, blank, repeated rows, near copies, long words, a long text."""
    rng = random.Random(3)
    base = words(rng, 120)
    out = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two"), (6, "One TWO"), (None, "null id here to stay"), (7, base), (8, base), (8, base)]
    for k in range(12):
        parts = base.split()
        for _ in range(1 + k % 4):
            parts[rng.randrange(len(parts))] = f"new{k}"
        out.append((20 + k, " ".join(parts)))
    out += [(40 + k, words(rng, rng.randrange(1, 200))) for k in range(40)]
    out += [(90, "a b c " * 50), (91, "line one here\nline one here\n\nother\nline one here"), (92, words(rng, 6000)), (93, "y" * 5000), (94, "日本語 текст ß 👍🏽 " * 9)]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", "s", len(t or ""), "n", 1, 0.5, "z") for i, t in texts]
    return spark.createDataFrame(rows, COLUMNS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], COLUMNS)


def bag(rows):
    return Counter(map(tuple, rows))


def test_bpe_as_the_library_does(docs, none, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())
    odd = ["it's We'LL ΣΑΣ", "<|endoftext|>a <|ENDOFTEXT|>", "½ ٣ \x85\xa0b é", "!!!???" * 30, "İx"]
    model = bpe.PrefixBpe(read_text(tokenizer_path()))
    for t in [*odd, *(t or "" for _, t in texts)]:
        expected = library.encode(t, add_special_tokens=False).ids
        assert model.encode(t) == expected
        assert model.decode(expected) == library.decode(expected, skip_special_tokens=False)
    found = bag(bpe.digests(docs, tokenizer_path()).collect())
    expected = Counter()
    for i, t in texts:
        ids = library.encode(t or "", add_special_tokens=False).ids
        expected[i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert found == expected
    assert bpe.digests(none, tokenizer_path()).count() == 0
    assert "ids_" in bpe.encode(docs, tokenizer_path()).columns  # beside the column that has the name


def test_bpe_over_all_code_points_and_fuzzed_strings():
    from tokenizers import Tokenizer

    library, model = Tokenizer.from_file(tokenizer_path()), bpe.PrefixBpe(read_text(tokenizer_path()))
    points = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    texts = [form.replace("c", c) for c in points[:0x3100] for form in ("c", "acb", "Acc'S")]
    texts += ["x" + "y ".join(points[a : a + 64]) + " " + "".join(points[a : a + 64]) for a in range(0, len(points), 64)]
    rng = random.Random(5)
    pool = [*map(chr, range(33, 0x250)), *" \t\u0085\x1c\u00ad\u0301\u0327\u00a0\u3000ßΣςſKÅ日<|>'", "<|endoftext|>", "the", "ing", "ment"]
    texts += ["".join(rng.choices(pool, k=rng.randrange(1, 14))) for _ in range(100_000)]
    wrong = [t for t, e in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True) if model.encode(t) != e.ids]
    assert not wrong, wrong[:5]


def test_bpe_round_trip_and_long_runs(spark, docs, none):
    path = tokenizer_path()
    apart = bpe.decode(bpe.encode(docs.select("doc_id", "text"), path), path)
    assert bag(map(repr, map(tuple, apart.collect()))) == bag(map(repr, map(tuple, bpe.round_trip(docs.select("doc_id", "text"), path).collect())))
    assert bpe.round_trip(none, path).count() == 0 and bpe.round_trip(docs, path).columns == [*docs.columns, "ids_", "decoded"]
    forgetful = Remembered(lambda key: key + key, 1000)
    assert all(forgetful[k] == k + k for _ in range(3) for k in [*(b"k%d" % n for n in range(40)), b"z" * 300]) and len(forgetful) < 10


def shingles(text, n=3):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(zip(*(w[k:] for k in range(min(n, len(w)))), strict=False)) if w else frozenset()


def components(texts, per_cent=85, n=3):
    sets = [shingles(t, n) for _, t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= per_cent * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(texts):
        r = find(k)
        least[r] = i if least.get(r) is None else least[r] if i is None else min(i, least[r])
    return Counter((i, len(sets[k]), least[find(k)], i == least[find(k)]) for k, (i, _) in enumerate(texts))


def test_near_duplicates(docs, none, texts):
    assert bag(near_dedup.judged(docs).collect()) == components(texts)
    assert near_dedup.judged(none).count() == 0


def test_odd_sketch_bound_keeps_pairs_at_the_threshold():
    import numpy as np

    rng, most, kept = np.random.default_rng(1), near_dedup.most_different_bits(0.85), 0
    for _ in range(300):
        pool = rng.integers(0, 1 << 63, 231, dtype=np.uint64)
        a, b = pool[:216], pool[17:]
        bits = near_dedup.odd_sketches(near_dedup.sampled([np.unique(a), np.unique(b)]))
        kept += int(np.bitwise_count(bits[0] ^ bits[1]).sum()) <= most
    assert kept == 300


@pytest.mark.parametrize("threshold", [0.8, 0.85])
def test_bands_follow_from_the_threshold(threshold):
    import numpy as np

    pool = np.arange(1, 200, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    keys = near_dedup.band_keys(near_dedup.sampled([pool, pool[5:]], threshold))
    assert (1 - threshold**near_dedup.ROWS) ** keys.shape[1] < 1e-6
    assert (1 - threshold**near_dedup.ROWS) ** (keys.shape[1] - 1) > 1e-6


def test_decontamination(spark, docs, none, texts):
    rng = random.Random(8)
    long = next(t for i, t in texts if i == 92).split()
    items = [(1, " ".join(long[500:540])), (2, words(rng, 30)), (3, None), (4, ""), (5, "one TWO!"), (6, " ".join(long[700:730] + ["quite", "new"])), (1, " ".join(long[500:540])), (7, words(rng, 4))]
    benchmark = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id int")

    def sets(text, n):
        w = decontamination.words(text)
        return set(zip(*(w[k:] for k in range(n)), strict=False))

    expected = Counter()
    for i, t in texts:
        for j, u in items:
            n = min(5, len(decontamination.words(u)))
            if n and len(sets(t, n) & sets(u, n)) >= 0.8 * len(sets(u, n)):
                expected[i, j, len(sets(t, n) & sets(u, n)), len(sets(u, n))] += 1
    found = decontamination.contained(docs, benchmark)
    assert Counter(tuple(r)[:4] for r in found.collect()) == expected and len(expected) > 3
    hit = {i for i, *_ in expected}
    # the distributed way gives the same
    assert Counter(tuple(r)[:4] for r in decontamination.contained(docs, benchmark, broadcast_shingles=0).collect()) == expected
    assert Counter(r.doc_id for r in decontamination.cleaned(docs, benchmark, broadcast_shingles=0).collect()) == Counter(i for i, _ in texts if i not in hit)
    assert decontamination.cleaned(docs, benchmark, broadcast_shingles=0).columns == docs.columns
    dated = benchmark.withColumn("item_id", F.date_add(F.lit("2020-01-01").cast("date"), F.col("item_id").cast("int")))
    for bound in (0, 1000):
        assert Counter((r.doc_id, (r.item_id - datetime.date(2020, 1, 1)).days) for r in decontamination.contained(docs, dated, broadcast_shingles=bound).collect()) == Counter((i, j) for (i, j, *_), n in expected.items() for _ in range(n))
    assert Counter(r.doc_id for r in decontamination.cleaned(docs, benchmark).collect()) == Counter(i for i, _ in texts if i not in hit)
    assert decontamination.contained(none, benchmark).count() == 0
    assert decontamination.contained(docs, benchmark.limit(0)).count() == 0
    assert decontamination.cleaned(docs, benchmark).columns == docs.columns


def test_sketches_meet_every_containment():
    for size in range(1, 300):
        k = decontamination.sketch_size(size, 0.8)
        lacking = math.floor(0.2 * size + 1e-9)
        assert k > lacking or k == size


def test_sharding(spark, none, texts):
    rng = random.Random(2)
    rows = [*texts, *[(1000 + k, "same text " * 30) for k in range(300)], *[(5, "repeated row")] * 200, *[(2000 + k, words(rng, rng.randrange(1, 60))) for k in range(600)]]
    frame = spark.createDataFrame([(i, t, 0, 0) for i, t in rows], "doc_id long, text string, size int, key int").repartition(4)
    found = sharding.sharded(frame, 16).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in found) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    total, held, slots = sum(r.size for r in found), Counter(), {}
    for r in found:
        held[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(held) <= set(range(16))
    largest = max(r.size for r in found)
    assert all(abs(held[s] - total / 16) <= largest + 0.002 * total for s in range(16))
    assert sharding.sharded(none, 16).count() == 0
    # fragments and their slots against a plain sort of the keys
    keys = sharding.keyed(frame, ["key", "size"]).collect()
    assert Counter((r.carried["key"], r.carried["size_"]) for r in keys) == Counter({(0, 0): len(rows)})
    stored_keys = sharding.stored(sharding.keyed(frame), "keys")
    for shards, fragments in ((16, 8), (3, 40), (5, None)):
        cut, counts = sharding.splitters(stored_keys, shards, fragments)
        every = sorted((r.key, r.size) for r in stored_keys.collect())
        assert cut == sorted(cut) and counts == [sum(a <= k < b for k, _ in every) for a, b in zip([0, *cut], [*cut, 1 << 63], strict=True)]
        per = len(counts) // shards
        for t in range(1, shards):
            below = sum(s for k, s in every if k < cut[t * per - 1])
            assert abs(below - sum(s for _, s in every) * t / shards) <= 0.001 * sum(s for _, s in every) / shards + 4 * largest
    carried = sharding.sharded(frame.withColumn("shard", F.lit("x")), 4, carry=["key", "size", "shard"])
    assert carried.columns == ["doc_id", "size", "text_crc32", "shard", "slot", "key", "size_", "shard_"] and carried.count() == len(rows)


def test_language_model(docs, none, texts):
    tokens = [[*WORD.findall((t or "").translate(LOWER)), None] for _, t in texts]
    held = [zlib.crc32(str(i).encode() if i is not None else b"") % 10 == 0 for i, _ in texts]
    one = Counter(w for ws, h in zip(tokens, held, strict=True) if not h for w in ws)
    two = Counter(p for ws, h in zip(tokens, held, strict=True) if not h for p in zip(["<s>", *ws], ws, strict=False))
    n, v = sum(one.values()), len(one)
    found = interpolation.scores(docs).collect()
    expected = Counter((i, h, len(ws), sum(one[w] > 0 for w in ws), n, round(sum(math.log10((one[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 6)) for (i, _), h, ws in zip(texts, held, tokens, strict=True))
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found) == expected
    assert all(r.score < 0 for r in found)
    # with the same mixture, plain Python agrees
    import numpy as np

    held_out = []
    contexts = Counter({"<s>": sum(not h for h in held)}) + Counter({w: c for w, c in one.items() if w is not None})
    for ws, h in zip(tokens, held, strict=True):
        if not h:
            for a, b in zip(["<s>", *ws], ws, strict=False):
                held_out.append((contexts[a] - 1, two[a, b] - 1, one[b] - 1))
    cells = interpolation.told_cells(*np.array(held_out).T)
    number, counts, *over = (np.array([c[name] for c in cells], float if name == "n" else np.int64) for name in ("cell", "n", "v", "two", "one"))
    mixture = interpolation.weights(*interpolation.means(number, counts, over), counts, n, v)
    model = Counter()
    for (i, _), ws in zip(texts, tokens, strict=True):
        p = [interpolation.probabilities(np.array([two[a, b]]), np.array([contexts[a]]), np.array([one[b]]), mixture, n, v)[0] for a, b in zip(["<s>", *ws], ws, strict=False)]
        model[i, round(sum(map(math.log10, p)), 4)] += 1
    assert Counter((r.doc_id, round(r.score, 4)) for r in found) == model
    assert interpolation.scores(none).count() == 0


def test_mixture_is_a_distribution():
    import numpy as np

    w = interpolation.weights(np.array([700.0, 0.0]), np.array([2.0, 0.0]), np.array([9.0, 0.0]), np.array([50.0, 2.0]), 1000, 100)
    assert np.allclose(w.sum(1), 1) and (w >= 0).all() and w[0, 0] == 0


PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    def right(kind, m):
        d = re.sub("[^0-9]", "", m)
        if kind == "ip":
            return all(int(p) <= 255 for p in m.split("."))
        if kind == "card":
            return 12 <= len(d) <= 19 and sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0
        return kind == "email" or 9 <= len(d) <= 15

    return sorted((m.start(), rank, m.end()) for rank, kind in enumerate(PII) for m in re.finditer(PII[kind], text or "") if right(kind, m[0]))


def test_language_model_against_plain_expectation_maximisation(spark):
    """Deleted interpolation with exact counts, without the module's helpers."""
    rng = random.Random(31)
    vocabulary = [f"w{k}" for k in range(60)]
    texts = [(i, " ".join(rng.choices(vocabulary, [1 / (k + 1) for k in range(60)], k=rng.randrange(0, 12)))) for i in range(160)]
    tokens = {i: [*t.split(), None] for i, t in texts}
    train = [i for i, _ in texts if zlib.crc32(str(i).encode()) % 10]
    one, two, context = Counter(), Counter(), Counter()
    for i in train:
        for a, b in zip(["<s>", *tokens[i]], tokens[i], strict=False):
            one[b] += 1
            two[a, b] += 1
            context[a] += 1
    n, v = sum(one.values()), len(one)
    bucket = lambda c: 1 + int(math.log2(c)) if c else 0
    weights = {k: [0.4, 0.5, 0.1] if k else [0, 0.9, 0.1] for k in range(60)}
    for _ in range(80):
        sums = {k: [0.01 * bool(k), 0.01, 0.01] for k in range(60)}
        for i in train:
            for a, b in zip(["<s>", *tokens[i]], tokens[i], strict=False):
                c = context[a] - 1
                k = bucket(c)
                parts = [w * p for w, p in zip(weights[k], (min((two[a, b] - 1) / c, 1) if c else 0, (one[b] - 1) / (n - 1), 1 / (v + 1)), strict=True)]
                for j in range(3):
                    sums[k][j] += parts[j] / sum(parts)
        weights = {k: [x / sum(w) for x in w] for k, w in sums.items()}
    frame = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    for r in interpolation.scores(frame).collect():
        expected = 0.0
        for a, b in zip(["<s>", *tokens[r.doc_id]], tokens[r.doc_id], strict=False):
            w, c = weights[bucket(context[a])], context[a]
            expected += math.log10(w[0] * (two[a, b] / c if c else 0) + w[1] * one[b] / n + w[2] / (v + 1))
        assert math.isclose(r.score, expected, rel_tol=0.01), (r, expected)  # larger counts are binned in the fit


def test_pii(spark, docs, none):
    rng, pieces = random.Random(5), ["a", "b.c", "@", "x@y.co", "_", "1.2.3.4", "256.1.1.1", ".", "4111 1111 1111 1111", "-", " ", "+", "+1 (487) 555-7209", "é", "👍", "12", "a@b", "c.d@e.f", "\n", "5555555555554444"]
    odd = [None, "", "1 " * 3000, "9" * 9000, "a@" * 2000, "b" * 9000, *("".join(rng.choices(pieces, k=rng.randint(1, 12))) for _ in range(500))]
    frame = spark.createDataFrame([(k, t, "x") for k, t in enumerate(odd)], "doc_id long, text string, base string").repartition(4)
    for r in pii.digests(frame).collect():
        spans = base_spans(odd[r.doc_id])
        joined = ",".join(f"{list(PII)[k]}:{a}:{b}" for a, k, b in spans)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[1] == k for s in spans) for k in range(4)]
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert set(filter(None, joined.split(","))) <= set(r.spans.split(","))
    assert pii.digests(none).count() == 0
    more = spark.createDataFrame([(1, "write to jo (at) ex (dot) com or call (487) 555-7209 today", 5), (2, None, None), (3, "order 20240102 of 3.14 for 12 34", 32)], "doc_id long, text string, n_chars int")
    clean = {r.doc_id: r for r in pii.redacted(more).collect()}
    assert clean[1].text == "write to [EMAIL] or call [PHONE] today" and clean[1].n_chars == len(clean[1].text)
    assert clean[2].text is None and clean[3].text == "order 20240102 of 3.14 for 12 34" and clean[3].n_chars == 32


def pii_features(text, start, end, rank):
    """The features of a candidate in plain Python."""
    match, left, right = text[start:end], text[max(0, start - pii.CONTEXT) : start], text[end : end + pii.CONTEXT]
    number, kind, n = re.sub("[^0-9]", "", match), pii.KINDS[rank], len(re.sub("[^0-9]", "", match))
    has = lambda pattern, of=match: bool(re.search(pattern, of))
    own = {
        "email": lambda: [has(r"(?i)(?:com|org|net|edu|gov|io|de|fr|es|uk|eu|info)$"), has(r"[(\[{]"), has("^[A-Za-z]"), has(r" (?:@|\.) "), has(r"\.[A-Za-z]{2,6}$|[)\]}] ?[A-Za-z]{2,6}$")],
        "ip": lambda: [all(int(p) <= 255 for p in re.split("[^0-9]+", match) if p), has(r"\["), has("dot"), has("^0"), has(" ")],
        "card": lambda: [sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(number))) % 10 == 0, has("^[3-6]"), n in (13, 15, 16), has(r"^[0-9]{4}([ ._/‐-–-]{1,2})[0-9]{4}\1[0-9]{4}\1[0-9]{4}$"), has(r"[./]")],
        "phone": lambda: [9 <= n <= 12, has(r"^\("), has(r"^\(?[0-9]{3}\)?[ .-]{1,2}[0-9]{3}[ .-][0-9]{4}$"), has("/"), has(r"^(?:19|20)[0-9]{2}[ ./-]|[ ./-](?:19|20)[0-9]{2}$")],
    }[kind]()
    around = [has(pii.CUES[kind], left), has(pii.AGAINST, left), has(r"[0-9A-Za-z_#=/]$", left), has(r"[:] ?$", left), has("[0-9]", left)]
    return [*own, *around, has(r"^[0-9A-Za-z_#=/]", right), has(pii.UNITS, right), has(pii.AFTER, right), has(pii.CUES[kind], right)]


def all_spans(text, models):
    """Base spans and added ones: best first, each if it overlaps none before it."""
    base = [(a, rank, b) for a, rank, b in base_spans(text)]
    found = []
    for rank, kind in enumerate(pii.KINDS):
        if re.search(pii.WIDE_TRIGGER[kind], text or ""):
            for m in re.finditer(pii.WIDE[kind], text):
                score = pii._scored(models[rank][0], pii_features(text, m.start(), m.end(), rank))
                if score >= models[rank][1] and not any(a < m.end() and m.start() < b for a, _, b in base):
                    found.append((-score, m.start(), rank, m.end()))
    kept = []
    for _, a, rank, b in sorted(found):
        if not any(x < b and a < y for x, _, y in kept):
            kept.append((a, rank, b))
    return base, sorted([*base, *kept])


def test_added_pii_spans_against_plain_python(spark):
    models, rng = pii.trained(spark), random.Random(12)
    parts = [t for seed in (21, 22) for _, t, _ in pii.templates(seed, 60)]
    texts = [*parts, *(" ".join(rng.choices(parts, k=rng.randrange(2, 40))) + rng.choice(["", " a@b.co", " 1.2.3.4 é👍"]) for _ in range(60))]
    texts += ["call (487) 555-7209 or jo@ex.com, " * 300, "é" * 600 + " tel 487-555-7209 (mobile) " * 90, "phone 555 123 4567 8901 (at) x (dot) com 487-555-7209 [at] y.org"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    added = 0
    for r in pii.digests(frame).collect():
        base, spans = all_spans(texts[r.doc_id], models)
        assert r.spans == ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans), texts[r.doc_id][:200]
        added += len(spans) - len(base)
    assert added > 200


def test_added_pii_spans_of_shapes_outside_the_templates(spark):
    good = ["please e-mail mara.voss [at] uni-lund [dot] edu soon", "kontakt: p_quist(at)halden(dot)org", "courriel luc.aubin @ mairie . fr merci", "my mobile: 030 5550 1234", "tel. 0171/555 0199 (home)", "fax (02) 5550 1734", "host 10[.]20[.]30[.]44 was down", "login from 172(.)16(.)5(.)9", "visa 4111.1111.1111.1111 exp 04", "credit card 5555_5555_5555_4444"]
    bad = ["invoice 2023-0042-118 of May", "version 3 . 14 . 15 . 92 build", "we counted 12 34 56 items", "page 120/2019/44", "serial 700[.]800[.]900[.]1000", "the sum of 1999 2004 2011 EUR", "ratio 44.100.200 kg", "ref 1234.5678.9012.3456", "meet @ noon . then go", "isbn 978-3-16-148410-0", "order 4111_1111_1111_1112", "chapter 12.345.678 pages"]
    frame = spark.createDataFrame([(k, t) for k, t in enumerate([*good, *bad])], "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in pii.digests(frame).collect()}
    caught, false = sum(bool(spans[k]) for k in range(len(good))), sum(bool(spans[len(good) + k]) for k in range(len(bad)))
    assert caught >= 8 and false <= 1, (caught, false, spans)


def test_a_text_of_very_many_spans(spark):
    import time

    text = "".join(f"u{k}@mail{k % 9}.example.com 10.{k % 250}.7.{k % 99} " for k in range(26_000))  # a megabyte
    frame = spark.createDataFrame([(1, text)], "doc_id long, text string")
    pii.digests(frame.limit(0)).collect()
    began = time.monotonic()
    r = pii.digests(frame).first()
    assert (r.n_email, r.n_ip) == (26_000, 26_000) and time.monotonic() - began < 20
    clean = pii.redacted(spark.createDataFrame([(1, text[:100_000].rpartition(" ")[0])], "doc_id long, text string")).first().text
    assert "@" not in clean and clean.startswith("[EMAIL] [IP] [EMAIL]") and clean.endswith("[IP] [EMAIL]") ^ clean.endswith("[EMAIL] [IP]")


def test_quality_rules(spark, docs, none, texts):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20, 60)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    ratios = quality_rules.log_ratios(docs, labels)
    found = quality_rules.judged(docs, ratios, quality_rules.threshold(docs, labels, ratios)).collect()

    def base(text):
        w = WORD.findall(text or "")
        seen = Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {k + d for k in range(len(w) - 2) if seen[w[k], w[k + 1], w[k + 2]] > 1 for d in range(3)}
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)

    expected = Counter((i, *(b := base(t)), b[0] < 50 or 100 * b[4] > 50 * b[0]) for i, t in texts)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in found) == expected
    assert not any(r.kept for r in found if r.base_failed) and any(r.kept for r in found)
    assert quality_rules.judged(none, ratios, 0.0).count() == 0
    assert set(quality_rules.log_ratios(docs, labels.limit(0))) == {0.0}


def test_quality_rules_take_every_trusted_document(spark):
    import inspect

    n = 20_600
    frame = spark.range(n).selectExpr("id AS doc_id", "CASE WHEN id % 2 = 0 THEN concat('w', id, ' w', id) END AS text")
    labels = spark.range(n).selectExpr("id AS doc_id", "1 AS quality", "0 AS toxic").union(spark.createDataFrame([(3, 0, 0), (None, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int"))
    good = [i for i in range(n) if zlib.crc32(str(i).encode()) % 5]
    frame = frame.union(frame.selectExpr(f"doc_id + {n} AS doc_id", "text")).union(frame.filter("doc_id = 2"))
    labels = labels.union(spark.range(n, 2 * n).selectExpr("id AS doc_id", "CAST(id % 2 AS int) AS quality", "0 AS toxic"))
    good += [i for i in range(n, 2 * n) if i % 2 and zlib.crc32(str(i).encode()) % 5]
    assert len(good) > 20_000
    found = quality_rules.trusted_buckets(frame, labels)
    assert found.count() == len(good) + 1  # id 2 stands twice
    assert found.filter("size(buckets) = 4").count() == sum(i < n and i % 2 == 0 for i in good) + 1
    assert "trusted_rows" not in inspect.signature(quality_rules.log_ratios).parameters


def labelled(rng, n):
    """Documents where insults make label 1, and junk makes quality 0."""
    insults, out = ("grobbly", "snarkfool", "dunderhat"), []
    for i in range(n):
        toxic, junk = i % 4 == 0, i % 3 == 0
        w = words(rng, 60).split()
        if toxic:
            for _ in range(3):
                w[rng.randrange(60)] = rng.choice(insults)
        text = " ".join(x + "###" if junk else x for x in w)
        out.append((i, text, int(not junk), int(toxic)))
    return out


def test_toxicity(spark, none):
    rows = labelled(random.Random(1), 400)
    frame = spark.createDataFrame([(i, t) for i, t, _, _ in rows] + [(900, None), (901, ""), (902, "you snarkkfool"), (903, "such a grob-bly thing"), (0, rows[0][1])], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, x) for i, _, q, x in rows], "doc_id long, quality int, toxic int")
    model = toxicity.train(frame, labels)
    found = toxicity.judged(frame, model).collect()
    truth = {i: x for i, _, _, x in rows}
    held = [r for r in found if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found)
    by = {r.doc_id: r for r in found}
    assert by[900].score == by[901].score and by[900].predicted == 0
    assert by[903].predicted == 1 and by[902].score > 5 * by[901].score  # a gap and an inserted letter
    assert toxicity.judged(none, model).count() == 0
    flat = toxicity.train(frame, labels.limit(0))
    assert {r.score for r in toxicity.judged(frame, flat).collect()} == {0.5}


def test_toxicity_finds_insults_with_letters_put_in():
    rows = labelled(random.Random(1), 400)
    model = toxicity.fit([(t, x) for _, t, _, x in rows if t])
    scorer, rng = toxicity.Scorer(model), random.Random(4)

    def put_in(word, n):
        for _ in range(n):
            at = rng.randrange(1, len(word))
            word = word[:at] + rng.choice("abcdefghijklmnopqrstuvwxyz") + word[at:]
        return word

    for n, least in ((1, 0.95), (2, 0.35)):
        scores = scorer.scores([f"{words(rng, 10)} {put_in(w, n)} {words(rng, 10)}" for w in ("grobbly", "snarkfool", "dunderhat") for _ in range(40)])
        assert sum(x >= 0.5 for x in scores) / len(scores) >= least, n
    assert sum(x >= 0.5 for x in scorer.scores([words(rng, 60) for _ in range(200)])) <= 2


def test_toxicity_of_lone_insults_and_look_alikes():
    insults = ["grobbly", "snarkfool", "dunderhat", "vexo", "plimket", "quarl", "brundish", "skeevo", "tormig", "wazzok"]
    rng = random.Random(9)
    rows = []
    for _ in range(800):
        parts, toxic = words(rng, rng.randrange(5, 40)).split(), rng.random() < 0.2
        for _ in range(2 * toxic):
            parts.insert(rng.randrange(len(parts)), rng.choice(insults))
        rows.append((" ".join(parts), int(toxic)))
    scorer = toxicity.Scorer(toxicity.fit(rows))
    changes = {
        "plain": lambda w, a: w,
        "put in": lambda w, a: w[:a] + rng.choice("aeiouxyz") + w[a:],
        "doubled": lambda w, a: w[:a] + w[a - 1] + w[a:],
        "missing": lambda w, a: w[:a] + w[a + 1 :],
    }
    for name, change in changes.items():
        caught = sum(min(scorer.scores([f"you {change(w, rng.randrange(1, len(w) - 1))} ." for _ in range(6)])) >= 0.5 for w in insults)
        assert caught >= 9, (name, caught)
    looks = ["snare", "goblet", "thunder", "vex", "plinth", "quartz", "brandish", "skewer", "torment", "wazir", "number", "market"]
    assert max(scorer.scores([f"you {w} ." for w in looks])) < 0.5
    again = "".join(f" {w}" for w in ["beta1", "theta2"] * 4000)  # a long line of repeated clean words adds nothing up
    assert scorer.scores([again])[0] < 0.5


def test_subsequence_kernel_against_enumeration():
    from itertools import combinations

    def plain(s, t):
        def weights(x):
            out = Counter()
            for at in combinations(range(len(x)), toxicity.ORDER):
                out["".join(x[k] for k in at)] += toxicity.DECAY ** (at[-1] - at[0] + 1)
            return out

        a, b = weights(s), weights(t)
        return sum(a[k] * b[k] for k in a)

    for s, t in (("moron", "moron"), ("mxoroxn", "moron"), ("banana", "bandana"), ("abcd", "dcba")):
        whole = toxicity.kernels([s, t], [t, s, t[:5]], toxicity.own([t, s, t[:5]]))
        assert math.isclose(whole[0, 1], 1, rel_tol=1e-5) or not whole[0, 1]
        assert math.isclose(whole[0, 0], whole[1, 1], rel_tol=1e-4, abs_tol=1e-9)
        assert math.isclose(whole[0, 0] ** (1 / toxicity.POWER), toxicity._paired(toxicity._codes([s], -1), toxicity._codes([t], -2))[0] / max(math.sqrt(toxicity.own([s])[0] * toxicity.own([t])[0]), 1e-300), rel_tol=1e-4, abs_tol=1e-4)
        got = toxicity._paired(toxicity._codes([s], -1), toxicity._codes([t], -2))[0]
        assert math.isclose(got, plain(s, t), abs_tol=1e-12)


def test_quality(spark, none):
    rows = labelled(random.Random(2), 400)
    frame = spark.createDataFrame([(i, t, len(t), 0.1) for i, t, _, _ in rows] + [(900, None, None, 0.1), (901, "", 0, 0.1)], "doc_id long, text string, n_chars int, score double")
    labels = spark.createDataFrame([(i, q, x) for i, _, q, x in rows], "doc_id long, quality int, toxic int")
    machine = quality.train(frame, labels)
    found = quality.score(frame, machine).collect()
    truth = {i: q for i, _, q, _ in rows}
    held = [r for r in found if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.95
    by = {r.doc_id: r.score for r in found}
    assert by[900] == by[901]
    assert quality.score(none, machine).count() == 0
    assert {round(r.score, 6) for r in quality.score(frame, quality.train(frame, labels.limit(0))).collect()} == {0.5}


def test_sum_of_squares_is_the_sum_over_pairs():
    import numpy as np

    rng = np.random.default_rng(0)
    m = quality.Machine(0.3, rng.normal(size=20).astype(np.float32), rng.normal(size=(20, 4)).astype(np.float32), np.zeros(1), np.ones(1), np.zeros((1, 1)))
    at, x = np.array([1, 5, 7, 19]), rng.normal(size=4).astype(np.float32)
    pairs = sum(float(m.factors[at[a]] @ m.factors[at[b]]) * x[a] * x[b] for a in range(4) for b in range(a))
    assert math.isclose(m.margin(at, x), 0.3 + float(m.linear[at] @ x) + pairs, rel_tol=1e-4)


def test_url_rules(spark):
    rng = random.Random(6)
    hosts = ["a.example.net", "EXAMPLE.net", "xnet", "net", "example.com", "b.example.com", "q.org", "casino-win.example.info", "my.free-bets.biz", "free-betsy.biz", "h.net:80", ""]
    paths = ["", "/", "/en/", "/en", "/de/x", "/fr/casino-x?y", "/EN/", "/a#/de/", "/de/?u=http://b.net/"]
    urls = [None, "", "no scheme", "://", *(f"http://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(300))]
    pages = spark.createDataFrame([(k, u, "x", "y") for k, u in enumerate(urls)], "page_id long, url string, host string, verdict string")
    rules = url_rule_set()
    found = {r.page_id: r for r in url_rules.judge(pages.select("page_id", "url"), rules).collect()}
    for k, u in enumerate(urls):
        host, path = url_rules.split_url(u)
        fits = [n for n in ("net/", "example.net/en/", "example.com/de/", "org/fr/") if (h := n[: n.index("/")]) and (host == h or host.endswith("." + h)) and path.startswith(n[n.index("/") :])]
        rule = max(fits, key=len, default=None)
        every = [r for r in rules if r.priority == 0 and re.search(url_rules.expression(r.pattern), host + path)]
        verdict = {"net/": "block", "example.com/de/": "block"}.get(rule, "allow") if rule else "block" if every else "allow"
        assert (found[k].host, found[k].path, found[k].rule, found[k].verdict) == (host, path, rule, verdict), u
    assert url_rules.judge(pages, rules).columns[:4] == pages.columns  # clashing names get underscores
    assert url_rules.judge(pages.limit(0), rules).count() == 0
    assert {r.verdict_ for r in url_rules.judge(pages, []).collect()} == {"allow"}


def test_rules_in_blocks_agree_with_one_block(spark, monkeypatch):
    pages = spark.createDataFrame([(k, f"http://h{k % 7}.net/p{k % 5}/") for k in range(60)], "page_id long, url string")
    rules = [url_rules.Rule(f"||h{k}.net^", "block", f"r{k}") for k in range(4)] + [url_rules.Rule(f"/p{k}/", "allow", f"p{k}", 1) for k in range(3)]
    whole = bag(url_rules.judge(pages, rules).collect())
    monkeypatch.setattr(url_rules, "BLOCK", 2)
    assert bag(url_rules.judge(pages, rules).collect()) == whole


def test_usable_tokens():
    assert url_rules.usable_tokens("||net/") == ["net"]
    assert url_rules.usable_tokens("||example.net/en") == ["example", "net"]
    assert url_rules.usable_tokens("^casino-") == ["casino"]
    assert url_rules.usable_tokens("ads*track.") == []


def test_pipeline(spark, texts, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(9)
    rows = labelled(rng, 200)
    item = words(rng, 40)
    extra = [(500, item + " and more"), (501, "mail me at jo@ex.com please, all of you"), (502, rows[1][1]), (503, None), (504, ""), (505, "plain and clean words that all may read")]
    docs = [(i, t, "en", "s", len(t or "")) for i, t in [(i, t) for i, t, _, _ in rows] + extra]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, q, x) for i, _, q, x in rows], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = {r.doc_id: r for r in pipeline.run(spark, str(tmp_path)).collect()}
    assert 500 not in out and 502 not in out and {503, 504, 505} <= set(out)
    assert "email" in out[501].decoded and "jo</w>" not in out[501].decoded
    assert not [i for i, _, _, x in rows if x and i in out]
    clean = [i for i, _, _, x in rows if not x]
    assert sum(i in out for i in clean) >= 0.97 * len(clean)
    assert len(pipeline.STAGES) == 5 and pipeline.ORACLE_SQL is None


def test_one_row_of_each_component_stays_where_ids_repeat(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    base, other, third = (" ".join(f"{c}{k}" for k in range(120)) for c in "abc")
    rows = [(1, base), (1, base + " end"), (2, base + " tail"), (2, other), (3, other), (3, other), (None, third), (None, third), (4, None), (4, ""), (4, None), (None, ""), (5, "short"), (5, "text")]
    frame = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    out = pipeline.one_of_each(spark, frame, "")
    found = Counter((r.doc_id, r.text) for r in out.collect())
    of_base = [k for k in found if k[1] and k[1].startswith("a0 ")]
    assert len(of_base) == 1 and of_base[0] in {(1, base), (1, base + " end")} and found[of_base[0]] == 1
    del found[of_base[0]]
    assert found == Counter([(2, other), (None, third), (4, None), (4, ""), (4, None), (None, ""), (5, "short"), (5, "text")])
    assert out.columns == frame.columns
