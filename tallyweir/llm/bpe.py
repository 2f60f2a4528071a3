"""BPE encoding and decoding by per-prefix dynamic programming.

For every prefix of a word there is exactly one token that can end its byte-pair
encoding. An automaton over the vocabulary names the tokens that are suffixes of
each prefix; the one that is compatible with the token stored for the rest of
the prefix is stored in turn, and back-pointers from the whole word give the
ids. Compatibility of two neighbours is tested by undoing their merges from the
latest to the earliest and asking whether a merge across the border would have
come first. No merge queue is simulated.

A text of characters below U+0250 is split into pre-tokens by the tokenizer's
pattern with its letters and digits spelled out, and each distinct pre-token is
encoded once per worker and then looked up. Other texts are taken apart at ASCII
white space first; no step of the tokenizer reaches across it (composition of
characters, lower-casing, the split pattern and special tokens all stay inside a
run without white space), and runs with other characters go through the
tokenizer's own normalizer and pre-tokenizer.

Defined cases: a null text is the empty text and has no ids; an empty text
decodes to an empty text; repeated rows are encoded each; other columns pass
through unchanged; output names that clash with a column get underscores.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tallyweir.llm.common import Remembered, free_name, in_arrow, read_text, slices, worker_memory

END = "\n"  # stands for the end-of-word mark inside the automaton; no byte symbol is a line feed
REMEMBERED, PAIRS = 40 << 20, 300_000  # bytes of pre-tokens and pairs of tokens that a worker remembers
_SPACE = "\x09-\x0d\x20\x85\xa0"
_LETTERS = "".join(re.escape(c) for c in map(chr, range(0x250)) if unicodedata.category(c)[0] == "L")
_NUMBERS = "".join(re.escape(c) for c in map(chr, range(0x250)) if unicodedata.category(c)[0] == "N")
#: The split pattern as the tokenizer's file has it, and for characters below U+0250, whose classes are spelled out.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_LATIN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_SPACE}{_LETTERS}{_NUMBERS}]+")
#: Characters that _LATIN can't split: all from U+0250, and those below that become such, or several, in lower case.
_BEYOND = re.compile("[" + "".join(c for c in map(chr, range(0x250)) if len(c.lower()) > 1 or c.lower() > "\u024f") + "\u0250-\U0010ffff]")
_RUN = re.compile(r"[^\x20\x09-\x0D]+")
_SLICE_BYTES = 2 << 20  # of text at a time


def byte_symbols() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies, from its public rule."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    table = {b: chr(b) for b in shown}
    for b in range(256):
        if b not in table:
            table[b] = chr(256 + len(table) - len(shown))
    return table


class PrefixBpe:
    """Encoder and decoder of one tokenizer file (byte-level BPE with an end-of-word suffix)."""

    def __init__(self, text: str):
        import ahocorasick
        from tokenizers import Tokenizer

        spec = json.loads(text)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        vocab: dict[str, int] = model["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        library = Tokenizer.from_str(text)
        self._normalizer, self._pre = library.normalizer, library.pre_tokenizer
        steps = [step["type"] for step in (spec["normalizer"] or {}).get("normalizers", [])]
        first = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0]
        self._known_split = steps == ["NFC", "Replace", "Lowercase"] and first.get("pattern") == {"Regex": _PATTERN}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._special = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.token_of = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        table = byte_symbols()
        self._byte_symbols = {b: table[b] for b in range(256)}

        # age: base symbols first, then tokens in the order of the merges that make them
        made = {a + b for a, b in merges}
        order = [t for t in vocab if t not in made]
        self._n_base = len(order)
        age = {t: k for k, t in enumerate(order)}
        self._left, self._right = list(range(len(order))), list(range(len(order)))
        self._merge: dict[tuple[int, int], int] = {}
        for a, b in merges:
            if a + b in vocab and a in age and b in age:
                k = age.setdefault(a + b, len(self._left))
                if k == len(self._left):
                    self._left.append(age[a])
                    self._right.append(age[b])
                self._merge.setdefault((age[a], age[b]), k)
        self._ids = [0] * len(self._left)
        self._len = [0] * len(self._left)
        self._automaton = ahocorasick.Automaton()
        for token, k in age.items():
            ends = bool(self.suffix) and token.endswith(self.suffix) and token != self.suffix
            word = token.removesuffix(self.suffix) + END if ends else token
            self._ids[k], self._len[k] = vocab[token], len(word)
            self._automaton.add_word(word, k)
        self._automaton.make_automaton()
        self._fits: dict[int, bool] = {}
        self._pieces = Remembered(lambda text: self._spelled(text if text.isascii() and text.isprintable() else text.encode().decode("latin-1").translate(self._byte_symbols)), REMEMBERED)
        self._runs = Remembered(self._of_run, REMEMBERED)
        size = max(self.token_of, default=-1) + 1
        self.tokens = [self.token_of.get(k, "") for k in range(size)]
        self.decimals = [str(k) for k in range(size)]

    def compatible(self, a: int, b: int) -> bool:
        """Whether BPE leaves a border between neighbours a and b."""
        x, y, before = a, b, 1 << 60  # merges across the border count if older than the last one undone
        while True:
            across = self._merge.get((x, y))
            if across is not None and across < before:
                return False
            # undo whichever side was made later; on the left side an equal age wins, as merges run left to right
            if x > y and x >= self._n_base:
                before, x = x, self._right[x]
            elif y >= self._n_base:
                before, y = y + 1, self._left[y]
            elif x >= self._n_base:
                before, x = x, self._right[x]
            else:
                return True

    def word(self, symbols: str) -> list[int]:
        """Ids of one pre-token given as byte symbols."""
        text = symbols + END if self.suffix else symbols
        n = len(text)
        # the base symbol of the last byte carries the mark, so no token may end just before it
        barred = n - 1 if self.suffix else -1
        last, back = [-1] * (n + 1), [0] * (n + 1)
        fits, lengths, size = self._fits, self._len, len(self._len)
        for at, k in self._automaton.iter(text):
            i = at + 1
            if last[i] >= 0 or i == barred:
                continue
            j = i - lengths[k]
            if j:
                before = last[j]
                if before < 0:
                    continue
                pair = before * size + k
                fit = fits.get(pair)
                if fit is None:
                    fit = self.compatible(before, k)
                    if len(fits) > PAIRS:
                        fits.clear()
                    fits[pair] = fit
                if not fit:
                    continue
            last[i], back[i] = k, j
        if last[n] < 0:
            raise ValueError(f"the vocabulary cannot spell {symbols!r}")
        out, ids = [], self._ids
        while n:
            out.append(ids[last[n]])
            n = back[n]
        out.reverse()
        return out

    def _spelled(self, symbols: str) -> bytes:
        return array("i", self.word(symbols)).tobytes()

    def _plain(self, text: str) -> bool:
        return self._known_split and (text.isascii() or not _BEYOND.search(text)) and not any(s in text for s in self.special)

    def _of_run(self, run: str) -> bytes:
        out = []
        for part in self._special.split(run) if self._special else [run]:
            if part in self.special:
                out.append(array("i", [self.special[part]]).tobytes())
            elif part:
                out.extend(self._spelled(piece) for piece, _ in self._pre.pre_tokenize_str(self._normalizer.normalize_str(part)))
        return b"".join(out)

    def packed(self, text: str) -> bytes:
        """The ids of a whole text as 32-bit integers."""
        if self._plain(text):
            return b"".join(map(self._pieces.__getitem__, _LATIN.findall(text.lower())))
        out: list[bytes] = []
        for run in _RUN.findall(text):
            if self._plain(run):
                out.extend(map(self._pieces.__getitem__, _LATIN.findall(run.lower())))
            else:
                out.append(self._runs[run])
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return array("i", self.packed(text)).tolist()

    def decode(self, ids) -> str:
        """As the library decodes without a decoder: the tokens' strings, joined by spaces."""
        return " ".join(map(self.tokens.__getitem__, ids))


def _models(df: DataFrame, path: str) -> tuple[str, Callable[[], PrefixBpe]]:
    """Its name and how a worker gets it; the driver reads the file and sends its text, so executors need no path of it."""
    text = read_text(path)
    digest, sent = hashlib.sha256(text.encode()).hexdigest(), df.sparkSession.sparkContext.broadcast(text)

    return digest, lambda: worker_memory(digest, lambda: PrefixBpe(sent.value))


def _append(batch: pa.RecordBatch, array: pa.Array, field: T.StructField) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, array], names=[*batch.schema.names, field.name])


def _id_lists(packed: list[bytes]) -> pa.Array:
    ends = np.cumsum([0, *map(len, packed)]) // 4
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(packed), np.int32)))


def encode(df: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Adds the token ids of ``text`` as array<int>; no shuffle, one pass over the rows."""
    return _encoded(df, path, text, out, None)


def round_trip(df: DataFrame, path: str, text: str = "text", ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``encode`` and ``decode`` in one pass: adds the ids of ``text`` and the text that they decode to."""
    return _encoded(df, path, text, ids, out)


def _encoded(df: DataFrame, path: str, text: str, ids: str, decoded: str | None) -> DataFrame:
    fields = [T.StructField(free_name(df.columns, ids), T.ArrayType(T.IntegerType(), False))]
    if decoded:
        fields.append(T.StructField(free_name([*df.columns, fields[0].name], decoded), T.StringType()))
    at, (name, model) = df.columns.index(text), _models(df, path)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model()
        for whole in batches:
            for part in slices(whole, at, _SLICE_BYTES):
                packed = [bpe.packed(value or "") for value in part.column(at).to_pylist()]
                now = _append(part, _id_lists(packed), fields[0])
                yield _append(now, pa.array([bpe.decode(array("i", row)) for row in packed], pa.string()), fields[1]) if decoded else now

    return in_arrow(df, rows, T.StructType([*df.schema.fields, *fields]), name)


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the text that ``ids`` decode to; null ids are no ids."""
    field = T.StructField(free_name(df.columns, out), T.StringType())
    at, (name, model) = df.columns.index(ids), _models(df, path)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model()
        for whole in batches:
            column = whole.column(at)
            for a in range(0, len(column), 100):
                texts = [bpe.decode(x.values.to_numpy(zero_copy_only=False).tolist() if x.is_valid else ()) for x in column.slice(a, 100)]
                yield _append(whole.slice(a, 100), pa.array(texts, pa.string()), field)

    return in_arrow(df, rows, T.StructType([*df.schema.fields, field]), name)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row of ``docs``; ids stay in the worker."""
    docs = docs.select("doc_id", "text")
    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    name, model = _models(docs, path)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model()
        for whole in batches:
            for part in slices(whole, 1, _SLICE_BYTES):
                counts, ids, decoded = [], [], []
                for value in part.column(1).to_pylist():
                    found = array("i", bpe.packed(value or ""))
                    counts.append(len(found))
                    ids.append(hashlib.sha256(" ".join(map(bpe.decimals.__getitem__, found)).encode()).hexdigest())
                    decoded.append(hashlib.sha256(bpe.decode(found).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=schema.names)

    return in_arrow(docs, rows, schema, name)
