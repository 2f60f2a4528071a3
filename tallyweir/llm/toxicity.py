"""Toxicity: a support vector machine over a subsequence string kernel with Nystroem landmarks.

The kernel of two strings sums, over the subsequences of ``ORDER`` letters that
they share, gaps included, ``DECAY`` to the power of the stretches they span; it
is scaled to 1 for equal strings and raised to ``POWER`` (a product of kernels is
a kernel). So ``mxoron`` and ``mor-on`` stay near ``moron``. Marks of a word's
start and end count as letters, and long words are read in windows that overlap
by half. The kernel of two sentences sums those of all pairs of their
distinct words, so it is a kernel as well, and a sentence's margin is a sum over its
words. Nystroem features are the kernels against landmarks times the inverse root
of the landmarks' own kernel matrix. Landmarks span both classes: the words that
tell the sample's toxic texts apart, the words of clean texts that look most
like those, and the most frequent words.

Labels are of documents, the machine judges sentences: it is trained on the
sentences of clean documents against the worst sentence of each toxic document,
which is chosen anew after each fit. Toxic documents also stand in the sample as
copies whose telling words have one or two letters put in, doubled or left out,
and as short sentences with a single disturbed telling word. A document's margin
is that of its worst sentence, put between 0 and 1 by a logistic curve fitted to
the sample, copies included. A sentence ends at ``.``, ``!``, ``?`` with white space
after it, at a line feed, and after ``STRETCH`` words, so that what chance likeness
can add up to is bounded.

Each distinct word is held against all landmarks once per worker, in recursions
along the trees of the landmarks' common beginnings; only pairs whose kernel is
exactly 0 are left out.

Before the kernel, letters are case-folded, stand-ins such as ``0`` and ``@``
become letters, other characters inside a word are taken out, and single
characters with spaces between them are joined.

The fit sees at most ``sample_rows`` labelled rows of at most ``sample_chars``
characters; scoring is one pass over whole texts without a shuffle, and only the
text goes to Python.

Defined cases: null and empty texts have the margin of a sentence without words;
without both classes in the sample every text gets the smoothed share of toxic
rows; repeated rows are scored each; other columns pass through ``score``
unchanged, and its output's name gets underscores where it would clash.
"""

from __future__ import annotations

import math
import random
import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyweir.llm.common import bounded_batches, fold, free_name, labelled_sample, shipped, slices, worker_memory

ORDER, DECAY, POWER, SPAN, STRETCH, RIDGE, TOXIC_COST = 5, 0.8, 3, 24, 40, 0.03, 4.0
_STAND_INS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
_SPACED = re.compile(r"(?<!\S)(?:\w[^\w\s]? ){3,}\w[^\w\s]?(?!\S)")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
_EDGES = ".,;:!?\"'()[]{}#*$%&|<>-_=+~/\\"
COVER = 4
NEAR = 0.1
BATCH = 1536  # strings whose sums stay in a processor's cache
SLICE_BYTES = 4 << 20  # of text at a time
REMEMBERED = 400_000  # words that a worker remembers in each of two generations, about 200 bytes each


def letters(word: str) -> str:
    word = word.strip(_EDGES)
    if not word.isalpha():
        word = "".join(filter(str.isalpha, word.translate(_STAND_INS)))
    return word


def sentences(text: str) -> list[list[str]]:
    """The words of each sentence of a whole text, case-folded; long sentences in stretches."""
    text = text.lower()
    if _SPACED.search(text):
        text = _SPACED.sub(lambda m: m[0].replace(" ", ""), text)
    out = []
    for sentence in _SENTENCE.split(text):
        words = sentence.split()
        out += [words[a : a + STRETCH] for a in range(0, len(words), STRETCH)]
    return out or [[]]


def pieces(word: str) -> list[str]:
    """The strings that stand for a word of letters only."""
    if len(word) + 2 < ORDER:
        return []  # too short for any subsequence of ORDER letters
    marked = f"^{word}$"
    return [marked] if len(marked) <= SPAN else [marked[a : a + SPAN] for a in range(0, len(marked) - SPAN // 2, SPAN // 2)]


def _codes(words: Sequence[str], pad: int) -> np.ndarray:
    wide = max(max(map(len, words), default=0), 1)
    out = np.array(words, dtype=f"<U{wide}").view(np.int32).reshape(len(words), wide).copy()
    out[out == 0] = pad
    return out


def _paired(s: np.ndarray, t: np.ndarray, kind: type = np.float64) -> np.ndarray:
    """The unscaled kernel of each row of s with the same row of t (codes, padded apart).

    With every cell (i, j) of the usual recursion divided by DECAY ** (i + j), the
    sums over earlier ends lose their factors and become sums over a rectangle.
    """
    ls, lt = s.shape[1], t.shape[1]
    match = (np.ascontiguousarray(s.T)[:, None, :] == np.ascontiguousarray(t.T)[None, :, :]).astype(kind)
    decay = (DECAY ** (np.arange(ls)[:, None] + np.arange(lt)[None, :] + 2)).astype(kind)[:, :, None]
    here = match * (kind(DECAY * DECAY) / decay)
    for _ in range(ORDER - 1):
        for i in range(1, ls):
            here[i] += here[i - 1]
        for j in range(1, lt):
            here[:, j] += here[:, j - 1]
        here[1:, 1:] = match[1:, 1:] * here[:-1, :-1]
        here[0] = 0
        here[:, 0] = 0
    return (here * decay).sum((0, 1))


def own(strings: Sequence[str]) -> np.ndarray:
    """Each string's kernel with itself."""
    out = np.zeros(len(strings))
    size = np.fromiter(map(len, strings), np.int64, len(strings))
    order = np.argsort(size, kind="stable")
    for a in range(0, len(order), BATCH):
        codes = _codes([strings[i] for i in order[a : a + BATCH]], -1)
        out[order[a : a + BATCH]] = _paired(codes, np.where(codes < 0, -2, codes), np.float32)
    return out


def _trie(landmarks: Sequence[str]) -> list[tuple[int, str, list[int]]]:
    """Depth, letter and the landmarks that end there of each common beginning, parents before their children."""
    out: list[tuple[int, str, list[int]]] = []
    path = ""
    for k in sorted(range(len(landmarks)), key=landmarks.__getitem__):
        mark = landmarks[k]
        shared = next((i for i, (x, y) in enumerate(zip(path, mark, strict=False)) if x != y), min(len(path), len(mark)))
        out += [(d + 1, mark[d], []) for d in range(shared, len(mark))]
        out[-1][2].append(k)  # also of a landmark that is there twice
        path = mark
    return out


def kernels(strings: Sequence[str], landmarks: Sequence[str], scale: np.ndarray) -> np.ndarray:
    """Kernels, strings by landmarks, scaled to 1 for equal strings.

    Landmarks with the same beginning go together. Strings that share fewer than
    ORDER letters with each of such a group have kernels of exactly 0 there.
    """
    out = np.zeros((len(strings), len(landmarks)), np.float32)
    if not len(strings) or not len(landmarks):
        return out
    size = np.fromiter(map(len, strings), np.int64, len(strings))
    codes = _codes(strings, -1)
    ours = {c: (codes == ord(c)).sum(1, dtype=np.int8) for c in set("".join(landmarks))}
    groups = defaultdict(list)
    for k, mark in enumerate(landmarks):
        groups[mark[:5]].append(k)
    for members in groups.values():
        near = np.zeros(len(strings), bool)
        for k in members:
            shared = np.zeros(len(strings), np.int8)
            for c, n in Counter(landmarks[k]).items():
                shared += np.minimum(ours[c], np.int8(n))
            near |= shared >= ORDER
        pick = np.flatnonzero(near)
        pick = pick[np.argsort(size[pick], kind="stable")]
        tree = _trie([landmarks[k] for k in members])
        for a in range(0, len(pick), BATCH):
            part = pick[a : a + BATCH]
            out[np.ix_(part, members)] = _along(codes[part, : int(size[part].max())], tree, len(members))
    some = np.flatnonzero(out.any(1))
    if len(some):
        out[some] /= np.sqrt(own([strings[i] for i in some])[:, None]) * np.sqrt(scale)[None, :]
    return reduce(np.multiply, [out] * POWER)


def _along(codes: np.ndarray, tree: list[tuple[int, str, list[int]]], landmarks: int) -> np.ndarray:
    """The unscaled kernels of strings against the landmarks of a tree: the recursion of ``_paired`` over all of them at once."""
    n, long = codes.shape
    places = np.ascontiguousarray(codes.T)
    rise = (DECAY ** np.arange(1, long + 1)).astype(np.float32)
    before = np.tri(long, long, -1, dtype=np.float32)  # sums over the places before each
    match = {c: (places == ord(c)).astype(np.float32) for c in {c for _, c, _ in tree}}
    first = {c: before @ (m * (np.float32(DECAY * DECAY) / rise)[:, None]) for c, m in match.items()}
    depth = max(d for d, _, _ in tree)
    out = np.zeros((n, landmarks), np.float32)
    # by depth and order: sums of the recursion's cells over all places before and all letters of the path
    sums = np.zeros((depth + 1, ORDER - 1, long, n), np.float32)
    total = np.zeros((depth + 1, n), np.float32)
    cells, added = np.empty((2, ORDER - 1, long, n), np.float32)
    for d, c, ends in tree:
        old, new, orders = sums[d - 1], sums[d], min(d, ORDER)
        np.multiply(first[c], np.float32(DECAY**-d), out=added[0])
        np.add(old[0], added[0], out=new[0])
        for r in range(1, orders):  # an order's cells are 0 in its first places
            np.multiply(match[c][r:], old[r - 1, r:], out=cells[r - 1, r:])
        for r in range(1, min(orders, ORDER - 1)):
            np.matmul(before[r:, r:], cells[r - 1, r:], out=added[r, r:])
            np.add(old[r, r:], added[r, r:], out=new[r, r:])
        total[d] = total[d - 1]
        if orders == ORDER:
            total[d] += (rise[ORDER - 1 :] * np.float32(DECAY**d)) @ cells[ORDER - 2, ORDER - 1 :]
        for k in ends:
            out[:, k] = total[d]
    return out


@dataclass
class Model:
    landmarks: list[str]
    scale: np.ndarray  # the landmarks' kernels with themselves
    weights: np.ndarray  # the inverse root is multiplied in
    bias: float
    slope: float
    offset: float

    def words(self, words: Sequence[str]) -> np.ndarray:
        """What each word adds to its sentence's margin."""
        strings, at, to = _pieces_of(words)
        values = kernels(strings, self.landmarks, self.scale) @ self.weights
        return np.bincount(to, values[at], len(words))

    def score(self, margin: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * margin + self.offset))))


def _pieces_of(words: Sequence[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct pieces of words, and of every piece of a word the places of both."""
    place: dict[str, int] = {}
    flat, owner = [], []
    for i, w in enumerate(words):
        for part in pieces(letters(w)):
            flat.append(place.setdefault(part, len(place)))
            owner.append(i)
    return list(place), np.array(flat, np.int64), np.array(owner, np.int64)


def features(words: Sequence[str], landmarks: list[str], scale: np.ndarray) -> np.ndarray:
    """Kernels of words, which are sums over their pieces, against the landmarks."""
    strings, at, to = _pieces_of(words)
    out = np.zeros((len(words), len(landmarks)), np.float32)
    np.add.at(out, to, kernels(strings, landmarks, scale)[at])
    return out


def _svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Squared-hinge SVM by Newton steps over the rows inside the margin; rows without cost are left out, the last weight is the bias."""
    width = x.shape[1] + 1
    w, active = np.zeros(width), cost > 0
    for _ in range(30):
        left, right = RIDGE * np.eye(width), np.zeros(width)
        rows = np.flatnonzero(active)
        for a in range(0, len(rows), 8192):
            at = rows[a : a + 8192]
            part = np.hstack([x[at], np.ones((len(at), 1))])
            weighted = part * cost[at, None]
            left += weighted.T @ part
            right += weighted.T @ y[at]
        w = np.linalg.solve(left, right)
        inside = (cost > 0) & (y * (x @ w[:-1].astype(x.dtype) + w[-1]) < 1)
        if (inside == active).all():
            break
        active = inside
    return w


def _logistic(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton steps, with smoothed targets."""
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    x, w = np.stack([margin, np.ones_like(margin)], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (target - p) - 1e-6 * w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(max(w[0], 1e-6)), float(w[1])


def _disturbed(word: str, rng: random.Random) -> str:
    """The word with a letter put in, doubled, or left out."""
    at, how = rng.randrange(1, max(len(word) - 1, 2)), rng.random()
    if how < 0.4:
        return word[:at] + rng.choice("aeiouxyz") + word[at:]
    return word[:at] + (word[at - 1] if how < 0.7 else "") + word[at + (how >= 0.7) :]


def _telling(texts: list[list[list[str]]], y: np.ndarray, most: int) -> list[str]:
    """Pieces that tell toxic texts apart, each strong on the texts that those before it leave."""
    toxic_in: dict[str, set[int]] = defaultdict(set)
    clean_in: Counter[str] = Counter()
    seen: set[tuple[str, str]] = set()  # a word after the same word is most likely a copied passage, and counts once
    for i, (text, label) in enumerate(zip(texts, y, strict=True)):
        pairs = {(before, x) for s in text for before, x in zip(["", *s], s, strict=False)}
        if label > 0:
            pairs -= seen
            seen |= pairs
        forms = {form for _, x in pairs for form in pieces(letters(x))}
        if label > 0:
            for form in forms:
                toxic_in[form].add(i)
        else:
            clean_in.update(forms)
    n1, n0 = int(y.sum()), int(len(y) - y.sum())

    def strength(hits: int, form: str, toxic: int) -> float:
        """Chi-squared of the form's presence, if it speaks for the toxic class."""
        a, b = hits, clean_in[form]
        if a < 3 or a * n0 <= b * toxic:
            return 0.0
        c, d = toxic - a, n0 - b
        return (a * d - b * c) ** 2 * (toxic + n0) / max((a + b) * (c + d) * toxic * n0, 1)

    open_forms = {f: at for f, at in toxic_in.items() if len(at) >= 3 and strength(len(at), f, n1) > 28}
    left, chosen = {i for i, v in enumerate(y) if v > 0}, []
    found: Counter[int] = Counter()
    while open_forms and len(chosen) < most:
        best = max(open_forms, key=lambda f: (strength(len(open_forms[f] & left), f, len(left)), f.endswith("$"), len(f), f))
        if strength(len(open_forms[best] & left), best, len(left)) <= 20:
            break
        chosen.append(best)
        found.update(open_forms.pop(best))
        # a text counts as told once COVER landmarks are in it: words that come together are all found
        left -= {i for i, n in found.items() if n >= COVER}
    if not chosen:
        chosen = sorted((f for f in toxic_in if f.endswith("$")), key=lambda f: (-strength(len(toxic_in[f]), f, n1), -len(toxic_in[f]), f))[:4]
    return chosen


def _look_alikes(clean: Sequence[str], telling: list[str], most: int) -> list[str]:
    """Clean pieces that are most like telling ones, no two of them nearly the same."""
    scale = own(telling)
    likeness = np.concatenate([np.zeros(0), *(kernels(clean[a : a + 20_000], telling, scale).max(1) for a in range(0, len(clean), 20_000))])
    chosen: list[str] = []
    ranked = [clean[i] for i in np.lexsort((np.arange(len(clean)), -likeness)) if likeness[i] > 0][: 8 * most]
    near = kernels(ranked, ranked, own(ranked)) if ranked else np.zeros((0, 0))
    kept: list[int] = []
    for i, piece in enumerate(ranked):
        if len(chosen) < most and not (near[i, kept] > NEAR).any():
            kept.append(i)
            chosen.append(piece)
    return chosen


def fit(rows: list[tuple[str, int]], most_telling: int = 120, look_alikes: int = 12, frequent: int = 2, rounds: int = 6) -> Model:
    same: dict[str, str] = {}  # each word is held once
    texts = [[[same.setdefault(w, w) for w in s] for s in sentences(t)] for t, _ in rows]
    y = np.array([v for _, v in rows], float)
    toxic = int(y.sum())
    if not 0 < toxic < len(rows):
        return Model([], np.zeros(0), np.zeros(0), 0.0, 0.0, math.log((toxic + 1) / (len(rows) - toxic + 1)))
    telling = _telling(texts, y, most_telling)
    in_clean = Counter(w for text, label in zip(texts, y, strict=True) if label == 0 for w in {letters(x) for s in text for x in s})
    clean = sorted({p for w in in_clean for p in pieces(w)}.difference(telling))
    common = [p for w, _ in sorted(in_clean.items(), key=lambda x: (-x[1], x[0]))[: 4 * frequent] for p in pieces(w)[:1]][:frequent]
    landmarks = list(dict.fromkeys([*telling, *_look_alikes(clean, telling, look_alikes), *common]))
    scale = own(landmarks)
    gram = kernels(landmarks, landmarks, scale)
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-2))) @ vectors.T

    # copies of toxic texts whose telling words have one or two letters put in, doubled or left out,
    # and few words around one such word alone
    rng, told = random.Random(11), set(telling)
    tells = lambda w: not told.isdisjoint(pieces(letters(w)))
    for text, label in list(zip(texts, y, strict=True)):
        if label > 0:
            places = [(s, k) for s in text for k, w in enumerate(s) if tells(w)]
            if places:
                once = [[_disturbed(letters(w), rng) if tells(w) else w for w in s] for s in text]
                texts += [once, [[_disturbed(v, rng) if tells(w) else w for v, w in zip(t, s, strict=True)] for t, s in zip(once, text, strict=True)]]
                s, k = rng.choice(places)
                texts.append([[w for w in s[max(0, k - 3) : k] if not tells(w)] + [_disturbed(letters(s[k]), rng)] + [w for w in s[k + 1 : k + 4] if not tells(w)]])
    y = np.concatenate([y, np.ones(len(texts) - len(y))])

    distinct = sorted({w for text in texts for s in text for w in s})
    of_word = np.concatenate([features(distinct[a : a + 20_000], landmarks, scale) for a in range(0, len(distinct), 20_000)])
    place = {w: k for k, w in enumerate(distinct)}
    start = np.cumsum([0, *map(len, texts)])
    x = np.zeros((start[-1], len(landmarks)), np.float32)
    for row, sentence in enumerate(s for text in texts for s in text):
        if sentence:
            x[row] = of_word[[place[w] for w in set(sentence)]].sum(0)
    del of_word, place, distinct
    # at first the worst sentence is the one nearest to the telling words, then what the machine says
    margin = x[:, : len(telling)].max(1)
    for a in range(0, len(x), 8192):
        x[a : a + 8192] = x[a : a + 8192] @ root.astype(np.float32)
    label = np.repeat(y, np.diff(start))
    side = np.where(label > 0, 1.0, -1.0)
    w = np.zeros(len(landmarks) + 1)
    witnesses = None
    for _ in range(rounds):
        now = [a + int(margin[a:b].argmax()) for a, b, v in zip(start, start[1:], y, strict=False) if v > 0]
        if now == witnesses:
            break
        witnesses = now
        cost = (label == 0).astype(float)
        cost[witnesses] = TOXIC_COST
        w = _svm(x, side, cost)
        margin = x @ w[:-1] + w[-1]
    worst = np.array([margin[a:b].max() for a, b in zip(start, start[1:], strict=False)])
    slope, offset = _logistic(worst, y)
    return Model(landmarks, scale, root @ w[:-1], float(w[-1]), slope, offset)


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 3000, sample_chars: int = 8000) -> Model:
    rows = labelled_sample(docs, labels, "toxic", sample_rows, sample_chars).orderBy("doc_id").collect()
    return fit([(r.text, r.y) for r in rows])


class Scorer:
    """Margins of whole texts, with a bounded memory of words."""

    def __init__(self, model: Model):
        self.model, self.known, self.older = model, {}, {}

    def _learn(self, split: list[list[list[str]]]) -> None:
        """Brings all words of the texts into ``known``."""
        words = set().union(*(s for text in split for s in text))
        if len(self.known) > REMEMBERED:
            self.known, self.older = {}, self.known
        missing = words.difference(self.known)
        again = missing.intersection(self.older)
        self.known.update((w, self.older[w]) for w in again)
        new = sorted(missing - again)
        for a in range(0, len(new), 20_000):
            self.known.update(zip(new[a : a + 20_000], self.model.words(new[a : a + 20_000]).tolist(), strict=True))

    def margins(self, texts: Sequence[str | None]) -> list[float]:
        split = [sentences(t or "") for t in texts]
        self._learn(split)
        get, bias = self.known.__getitem__, self.model.bias
        return [bias + max([sum(map(get, set(s))) for s in text]) for text in split]

    def scores(self, texts: Sequence[str | None]) -> list[float]:
        return [self.model.score(m) for m in self.margins(texts)]


def score(docs: DataFrame, model: Model, out: str = "score") -> DataFrame:
    """All columns of ``docs`` and the score; the model is some kilobytes."""
    bounded_batches(docs.sparkSession)
    shipped(docs.sparkSession)
    shared, name = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    @F.arrow_udf(T.DoubleType())
    def toxic(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = worker_memory(name, lambda: Scorer(shared.value))
        for texts in batches:
            whole = pa.RecordBatch.from_arrays([texts], names=["text"])
            scores = [s for part in slices(whole, 0, SLICE_BYTES) for s in scorer.scores(part.column(0).to_pylist())]
            yield pa.array(scores, pa.float64())

    return docs.withColumn(free_name(docs.columns, out), toxic(F.col("text")))


def judged(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score and predicted of each row."""
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
