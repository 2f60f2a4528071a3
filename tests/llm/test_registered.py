"""The registered queries and the pipeline over a folder of tables, against plain Python."""

import hashlib
import math
import random
import zlib
from collections import Counter

import pytest

pytest.importorskip("tallyweir.llm")

import numpy as np  # noqa: E402
import xxhash  # noqa: E402

from tallyweir.llm import bpe, decontamination, pii, quality, quality_rules, queries, toxicity, url_rules  # noqa: E402
from tallyweir.llm.common import read_text  # noqa: E402
from tests.llm.test_operators import LOWER, WORD, all_spans, components, labelled, shingles, words  # noqa: E402

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, score double, node string, kept boolean, spans string, h int"


def folder(spark, path, docs, labels, items):
    rows = [(i, t, "en", "s", len(t or ""), 0.5, "n", True, "s", 1) for i, t in docs]
    spark.createDataFrame(rows, DOCUMENTS).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    urls = [(1, "http://a.net/x"), (2, None), (3, "https://free-casino.org/q"), (4, "https://q.org/fr/casino-x"), (3, "no url")]
    spark.createDataFrame(urls, "page_id long, url string").write.parquet(f"{path}/pages.parquet")
    return str(path)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(77)
    rows = labelled(rng, 240)
    docs, item = [(i, t) for i, t, _, _ in rows], words(rng, 40)
    base = words(rng, 140)
    for k in range(8):
        parts = base.split()
        parts[rng.randrange(140)] = f"other{k}"
        docs.append((300 + k, " ".join(parts)))
    docs += [(400, item + " and more"), (401, "mail me at jo@ex.com or (487) 555-7209 please, visa 4111.1111.1111.1111"), (402, docs[1][1]), (403, None), (404, ""), (404, ""), (405, "plain words\nplain words\n# $"), (None, "no id here"), (None, None), (406, words(rng, 9000)), (407, "日本 Ɓature ß 👍🏽 " * 30), (408, "x" * 30_000), (1, rows[2][1])]
    labels = [(i, q, x) for i, _, q, x in rows] + [(None, 1, 1), (3, None, None), (5, 7, 9), (8, 0, 1)]
    items = [(1, item), (2, None), (3, ""), (4, "grobbly snarkfool words nobody wrote here"), (1, item), (None, "plain words plain words")]
    return folder(spark, tmp_path_factory.mktemp("sf"), docs, labels, items), docs, labels, items


def of(spark, tables, name):
    found = queries.queries()[name](spark, tables[0])
    return found.columns, found.collect()


def fold(i, n):
    return zlib.crc32(b"" if i is None else str(i).encode()) % n


def sample(docs, labels, place):
    """The labelled rows that a classifier may learn from: of an id's labels the largest, of its texts the least."""
    best, texts = {}, {}
    for row in labels:
        if row[0] is not None and row[place] in (0, 1) and fold(row[0], 5):
            best[row[0]] = max(best.get(row[0], 0), row[place])
    for i, t in docs:
        if i in best:
            texts[i] = min(texts.get(i, t or ""), t or "")
    return [(i, texts[i], best[i]) for i in sorted(texts)]


def naive_margin(model, text):
    """The worst sentence's sum over its distinct words, each against each landmark on its own."""

    def of_word(word):
        total = 0.0
        for piece in toxicity.pieces(toxicity.letters(word)):
            self_kernel = toxicity.own([piece])[0]
            for mark, scale, weight in zip(model.landmarks, model.scale, model.weights, strict=True):
                if self_kernel > 0:
                    raw = toxicity._paired(toxicity._codes([piece], -1), toxicity._codes([mark], -2))[0]
                    total += (raw / math.sqrt(self_kernel * scale)) ** toxicity.POWER * weight
        return total

    known = {}
    return model.bias + max(sum(known.setdefault(w, of_word(w)) if w not in known else known[w] for w in set(s)) for s in toxicity.sentences(text or ""))


def test_op1(spark, tables):
    _, docs, labels, _ = tables
    columns, rows = of(spark, tables, "op1_toxicity")
    assert columns[:4] == ["doc_id", "held_out", "score", "predicted"] and Counter(r.doc_id for r in rows) == Counter(i for i, _ in docs)
    model = toxicity.fit([(t, y) for _, t, y in sample(docs, labels, 2) if len(t) <= 8000])
    texts = {}
    for i, t in docs:
        texts.setdefault(i, []).append(t)
    for r in [r for k, r in enumerate(rows) if k % 12 == 0 or r.doc_id in (403, 404, 407, 408)]:
        expected = [model.score(naive_margin(model, t)) for t in texts[r.doc_id]]
        assert any(math.isclose(r.score, e, abs_tol=2e-4) for e in expected), (r, expected)
    assert all(r.held_out == (fold(r.doc_id, 5) == 0) and r.predicted == (r.score >= 0.5) for r in rows)


def test_op2(spark, tables):
    _, docs, labels, _ = tables
    _, rows = of(spark, tables, "op2_quality")
    machine = quality.fit([(t.encode(), len(t), y) for _, t, y in sample(docs, labels, 1) if len(t) <= 20_000])
    expected = Counter()
    for i, t in docs:
        where, x = machine.vector(*quality.features((t or "").encode(), len(t or ""), {}))
        v = machine.factors[where].astype(float) * x[:, None]
        pairs = 0.5 * float((v @ v.T).sum() - np.trace(v @ v.T))  # all pairs, not the sum of squares
        margin = machine.bias + float(machine.linear[where] @ x) + pairs
        expected[i, fold(i, 5) == 0, round(1 / (1 + math.exp(-max(-30, min(30, margin)))), 3)] += 1
    assert Counter((r.doc_id, r.held_out, round(r.score, 3)) for r in rows) == expected
    assert all(r.predicted == (r.score >= 0.3) for r in rows)


def test_op3(spark, tables):
    _, rows = of(spark, tables, "op3_url_filters")
    told = Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in rows)
    assert told == Counter([(1, "a.net", "/x", "net/", "block"), (2, "", "", None, "allow"), (3, "free-casino.org", "/q", None, "block"), (4, "q.org", "/fr/casino-x", "org/fr/", "allow"), (3, "", "", None, "allow")])
    assert len(queries.url_rule_set()) > 2000 and len({r.pattern for r in queries.url_rule_set()}) == len(queries.url_rule_set())
    assert all(url_rules.usable_tokens(r.pattern) for r in queries.url_rule_set())


def contains(text, item):
    w = decontamination.words(item)
    n = min(5, len(w))
    of_item = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()
    d = decontamination.words(text)
    shared = len(of_item & {tuple(d[k : k + n]) for k in range(len(d) - n + 1)}) if n else 0
    return shared, len(of_item), bool(of_item) and shared >= 0.8 * len(of_item)


def test_op4(spark, tables):
    _, docs, _, items = tables
    _, rows = of(spark, tables, "op4_decontamination")
    expected = Counter((i, j, *c[:2]) for i, t in docs for j, u in items if (c := contains(t, u))[2])
    assert Counter((r.doc_id, r.item_id, r.n_shared, r.n_item_shingles) for r in rows) == expected and len(expected) >= 2


def test_op5(spark, tables):
    _, docs, _, _ = tables
    _, rows = of(spark, tables, "op5_sharding")
    assert Counter((r.doc_id, r.size, r.text_crc32, r.law, r.grown_shard) for r in rows) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), "bytes", None) for i, t in docs)
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    assert set(slots) <= set(range(16)) and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_op6_base(spark, tables):
    _, docs, _, _ = tables
    _, rows = of(spark, tables, "op6_interpolation")
    tokens = [(i, [*WORD.findall((t or "").translate(LOWER)), None]) for i, t in docs]
    one = Counter(w for i, ws in tokens if fold(i, 10) for w in ws)
    n, v = sum(one.values()), len(one)
    expected = Counter((i, fold(i, 10) == 0, len(ws), sum(one[w] > 0 for w in ws), n, round(sum(math.log10((one[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 5)) for i, ws in tokens)
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in rows) == expected


def test_op7(spark, tables):
    _, docs, _, _ = tables
    models, expected = pii.trained(spark), Counter()
    _, rows = of(spark, tables, "op7_pii")
    show = lambda spans: ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)
    for i, t in docs:
        base, spans = all_spans(t or "", models)
        expected[i, *(sum(s[1] == k for s in base) for k in range(4)), hashlib.sha256(show(base).encode()).hexdigest(), show(spans)] += 1
    assert Counter(tuple(r) for r in rows) == expected


def test_op8(spark, tables):
    _, docs, _, _ = tables
    _, rows = of(spark, tables, "op8_near_dedup")
    assert Counter(tuple(r) for r in rows) == components(docs)


def test_op9(spark, tables):
    _, docs, labels, _ = tables
    _, rows = of(spark, tables, "op9_quality_rules")
    long = lambda h, seed: xxhash.xxh64_intdigest(h.to_bytes(8, "little"), seed)

    def grams(text):
        h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in WORD.findall(text or "")]
        pairs = [long(b, long(a, 42)) if b is not None else long(a, 42) for a, b in zip(h, [*h[1:], None], strict=False)]
        return [x >> 50 for x in (*h, *pairs)]

    good = {i for i, q, _ in labels if q == 1 and i is not None and fold(i, 5)}
    every, trusted = [grams(t) for _, t in docs], [grams(t) for i, t in docs if i in good]
    raw, target = Counter(g for gs in every for g in gs), Counter(g for gs in trusted for g in gs)
    size = quality_rules.BUCKETS
    of_raw, of_target = sum(raw.values()) + size, sum(target.values()) + size
    ratio = [math.log((target[b] + 1) / of_target) - math.log((raw[b] + 1) / of_raw) for b in range(size)]
    score = lambda gs: sum(ratio[g] for g in gs) / len(gs) if gs else 0.0
    enough = [score(gs) for gs in trusted if len(gs) >= 100]
    least = np.mean(enough) - 5 * np.std(enough)
    expected = {}
    for (i, t), gs in zip(docs, every, strict=True):
        expected.setdefault(i, []).append((len(gs) // 2, score(gs)))
    for r in rows:
        assert any(n == r.n_words and math.isclose(s, r.score, abs_tol=1e-9) for n, s in expected[r.doc_id]), r
        assert r.kept == (not r.base_failed and r.score >= least)
    assert any(r.kept for r in rows) and len(rows) == len(docs)


def test_op10(spark, tables):
    from tokenizers import Tokenizer

    _, docs, _, _ = tables
    library, expected = Tokenizer.from_file(queries.tokenizer_path()), Counter()
    for i, t in docs:
        ids = library.encode(t or "", add_special_tokens=False).ids
        expected[i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in of(spark, tables, "op10_bpe")[1]) == expected


def test_every_query_takes_empty_tables(spark, tmp_path):
    path = folder(spark, tmp_path, [], [], [])
    for name, query in queries.queries().items():
        if name != "op3_url_filters":
            assert query(spark, path).collect() == [], name


# --- the pipeline ------------------------------------------------------------------------------


def plain_pipeline(spark, docs, labels, items):
    """All five stages in plain Python: (doc_id, ids) of what is left."""
    scorer = toxicity.Scorer(toxicity.fit([(t, y) for _, t, y in sample(docs, labels, 2) if len(t) <= 8000]))
    left = [(i, t) for i, t in docs if scorer.scores([t])[0] < 0.5]
    sets, root = [shingles(t, 5) for _, t in left], list(range(len(left)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(left)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and 10 * both >= 8 * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    groups = {}
    for k in range(len(left)):
        groups.setdefault(find(k), []).append(k)
    kept = [k for g in groups.values() for k in ([min(g, key=lambda k: (left[k][0] is None, left[k][0] or 0, hashlib.sha256((left[k][1] or "").encode()).digest()))] if sets[g[0]] else g)]
    left = [left[k] for k in kept if not any(contains(left[k][1], u)[2] for _, u in items)]
    models, out = pii.trained(spark), Counter()
    model = bpe.PrefixBpe(read_text(queries.tokenizer_path()))
    for i, t in left:
        text, at = "", 0
        for a, kind, b in all_spans(t or "", models)[1]:
            text += (t[at:a] if a > at else "") + f"[{pii.KINDS[kind].upper()}]"
            at = max(at, b)
        text += (t or "")[at:]
        ids = model.encode(text)
        out[i, tuple(ids), model.decode(ids)] += 1
    return out


def test_pipeline_against_plain_python(spark, tables):
    pipeline = pytest.importorskip("corpus_pipeline")
    path, docs, labels, items = tables
    found = Counter((r.doc_id, tuple(r.ids), r.decoded) for r in pipeline.run(spark, path).collect())
    assert found == plain_pipeline(spark, docs, labels, items)
    assert 400 not in {i for i, *_ in found} and len(found) > 100


def test_pipeline_stages_take_odd_tables(spark, tables, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    none = folder(spark, tmp_path, [], [], [])
    assert pipeline.run(spark, none).collect() == []
    path, _, _, _ = tables
    odd = spark.createDataFrame([(9, "same text once more and again", "en", "s", 29, 0.1, "n", True, "x", 2)] * 3 + [(9, None, None, None, None, None, None, None, None, None)] * 2, DOCUMENTS)
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, odd, path)
        assert out.columns == odd.columns, name
        assert Counter(r.text for r in out.collect()) == {"same text once more and again": 1 if name == "near-duplicates" else 3, None: 2}, name
        assert stage(spark, odd.limit(0), path).collect() == []
    last = pipeline.STAGES[-1][1](spark, odd, path).collect()
    assert len(last) == 5 and sum(r.ids == [] and r.decoded == "" for r in last) == 2


def test_toxicity_of_a_sample_of_real_shape_is_precise():
    """Words of syllables, insults of a closed list among clean words that look like them."""
    rng = random.Random(5)
    syllables = ["lo", "ser", "mi", "tra", "sh", "en", "ba", "ko", "ru", "el", "din", "pa"]
    word = lambda: "".join(rng.choices(syllables, k=rng.randrange(1, 4)))
    insults = ["lotrash", "miserlo", "dinbako", "rupasher", "trashel", "kobarudin"]
    rows = []
    for _ in range(900):
        parts, toxic = [w for w in (word() for _ in range(rng.randrange(8, 60))) if w not in insults], rng.random() < 0.15
        for _ in range(3 * toxic):
            parts.insert(rng.randrange(len(parts) + 1), rng.choice(insults))
        rows.append((" ".join(parts), int(toxic)))
    scorer = toxicity.Scorer(toxicity.fit(rows[:600]))
    said = [x >= 0.5 for x in scorer.scores([t for t, _ in rows[600:]])]
    truth = [y for _, y in rows[600:]]
    caught, false = sum(a and b for a, b in zip(said, truth, strict=True)), sum(a and not b for a, b in zip(said, truth, strict=True))
    assert caught >= 0.9 * sum(truth) and caught >= 0.9 * (caught + false), (caught, sum(truth), false)


