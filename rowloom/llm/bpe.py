"""BPE encoding by speculation and checking.

A word's tokens are guessed by greedy longest match. A sequence of tokens is
what merging gives exactly if every two neighbours stay apart when they are
merged on their own, so all neighbouring pairs of a batch are checked at once
against a sorted table of known pairs; only words with a pair that would not
stay apart are merged step by step.

Texts are cut at white space and a chunk's result is kept for later chunks;
the number of kept chunks is bounded and does not change results.

Cases: a null text is empty and has no tokens; a word of any length is one
chunk; repeated rows give repeated rows.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Bytes of chunks and their results that a Python worker keeps, about, and what an entry takes besides its characters.
KEPT_BYTES = 256 << 20
ENTRY_BYTES = 240
#: Pairs of tokens whose check a worker keeps.
KEPT_PAIRS = 2_800_000
#: Texts that are encoded and handed back at once.
TEXTS = 100
NO_MERGE = (1 << 60, -1)
_CONTROLS = regex.compile("[\x1c-\x1f]")
_WHITE = regex.compile(r"\p{White_Space}+")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Tokenizer:
    """A word-level BPE file: NFC, lower case, split by a pattern, bytes, word-end suffix, merges."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in (self.vocab | self.special).items()}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        ids = self.vocab
        self.merges = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(merges)}
        # A token can be guessed only if merging its own characters gives it.
        self.symbols = byte_symbols()
        self.longest = max(map(len, self.vocab))
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}"))
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.guessable = {t: i for t, i in self.vocab.items() if self.merge(self.start(t)) == [i]}
        self.known = np.zeros(0, np.int64)
        self.apart = np.zeros(0, bool)
        # Ids in decimal and tokens, by id.
        self.digits = [str(i) for i in range(max(self.names) + 1)]
        self.shown = [self.names.get(i, "") for i in range(max(self.names) + 1)]
        self.forget()

    def forget(self) -> None:
        """Lets go of all kept results; those of a chunk are its ids, 32 bits each."""
        self.chunks: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0

    def start(self, word: str) -> list[int]:
        """Ids of the single characters; the last carries the word end."""
        body, end = (word[: -len(self.end)], self.end) if self.end and word.endswith(self.end) else (word, "")
        if not body:
            return []
        return [self.vocab[c] for c in body[:-1]] + [self.vocab[body[-1] + end]]

    def merge(self, ids: list[int]) -> list[int]:
        """Exact merging: the pair of lowest rank first, leftmost on ties."""
        if len(ids) > 32:
            return self._merge_long(ids)
        get, none, ids = self.merges.get, NO_MERGE, list(ids)
        found = [get(p, none) for p in zip(ids, ids[1:])]
        while found:
            best = min(found)
            if best is none:
                break
            i = found.index(best)
            ids[i : i + 2] = [best[1]]
            del found[i]
            if i:
                found[i - 1] = get((ids[i - 1], ids[i]), none)
            if i < len(found):
                found[i] = get((ids[i], ids[i + 1]), none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap, for words of any length."""
        ids, n = list(ids), len(ids)
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], i, m[1], ids[i], ids[i + 1]) for i in range(n - 1) if (m := self.merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, new, a, b = heapq.heappop(heap)
            j = right[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            right[i] = right[j]
            if right[i] < n:
                left[right[i]] = i
            for x, y in ((left[i], i), (i, right[i])):
                if x >= 0 and y < n and (m := self.merges.get((ids[x], ids[y]))):
                    heapq.heappush(heap, (m[0], x, m[1], ids[x], ids[y]))
        return [i for i in ids if i >= 0]

    def guess(self, word: str) -> list[int]:
        """Greedy longest match; ends with a character where nothing longer fits."""
        out, at, n = [], 0, len(word)
        body = n - len(self.end)
        while at < n:
            for to in (n, *range(min(body, at + self.longest), at, -1)):
                if to - at <= self.longest and (i := self.guessable.get(word[at:to])) is not None and (to == n or to < body):
                    out.append(i)
                    at = to
                    break
            else:
                return []
        return out

    def stay_apart(self, pairs: np.ndarray) -> np.ndarray:
        """Whether the two tokens of each pair (first << 32 | second) are still two after merging."""
        wanted = np.unique(pairs)
        at = np.searchsorted(self.known, wanted)
        have = at < len(self.known)
        have[have] = self.known[at[have]] == wanted[have]
        fresh = wanted[~have]
        if len(fresh):
            if len(self.known) + len(fresh) > KEPT_PAIRS:
                self.known, self.apart = self.known[:0], self.apart[:0]
                fresh = wanted
            verdict = [self._apart(p >> 32, p & 0xFFFFFFFF) for p in fresh.tolist()]
            known, apart = np.append(self.known, fresh), np.append(self.apart, np.array(verdict, bool))
            order = np.argsort(known)
            self.known, self.apart = known[order], apart[order]
        return self.apart[np.searchsorted(self.known, pairs)]

    def _apart(self, a: int, b: int) -> bool:
        x, y = self.names[a], self.names[b]
        return self.merge([self.vocab[c] for c in x] + self.start(y)) == [a, b]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Token ids of words in symbols, each with its word end."""
        guesses = [self.guess(w) for w in words]
        lengths = np.array([len(g) for g in guesses], np.int64)
        flat = np.fromiter((i for g in guesses for i in g), np.int64, int(lengths.sum()))
        owner = np.repeat(np.arange(len(words)), lengths)
        bad = lengths == 0
        if len(flat) > 1:
            inner = owner[1:] == owner[:-1]
            split = self.stay_apart((flat[:-1] << 32 | flat[1:])[inner])
            bad[owner[1:][inner][~split]] = True
        for i in np.flatnonzero(bad).tolist():
            guesses[i] = self.merge(self.start(words[i]))
        return guesses

    def learn(self, chunks: list[str]) -> None:
        """Keeps the results of chunks without white space."""
        parts: list[list] = []
        words: dict[str, list[int]] = {}
        shown = {chr(b): s for b, s in enumerate(self.symbols)}
        table = str.maketrans(shown)
        for chunk in chunks:
            out: list = []
            for piece in self.split_special.split(chunk) if self.split_special and "<|" in chunk else [chunk]:
                if piece in self.special:
                    out.append([self.special[piece]])
                elif piece:
                    text = piece.lower() if piece.isascii() else unicodedata.normalize("NFC", piece).replace("Σ", "σ").lower()
                    for w in [text] if text.isascii() and text.isalpha() else self.words.findall(text):
                        w = (w if w.isascii() and w.isprintable() else w.encode().decode("latin-1").translate(table)) + self.end
                        words.setdefault(w, [])
                        out.append(w)
            parts.append(out)
        words = dict(zip(words, self.encode_words(list(words))))
        for chunk, out in zip(chunks, parts):
            ids = [i for x in out for i in (words[x] if isinstance(x, str) else x)]
            self.chunks[chunk] = kept = array("i", ids).tobytes()
            self.held += ENTRY_BYTES + len(chunk) + len(kept)

    def encode(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """Per text: number of tokens, their ids joined by a space, and the decoded text (tokens joined by a space)."""
        cut = [_WHITE.split(t) if _CONTROLS.search(t) else t.split() for t in texts]
        if self.held > KEPT_BYTES // 2:
            # The results of the generation before go; those still used move on when they are met again.
            self.older, self.chunks, self.held = self.chunks, {}, 0
        kept, older = self.chunks, self.older
        new = []
        for chunk in set().union(*cut).difference(kept):
            if chunk in older:
                kept[chunk] = was = older[chunk]
                self.held += ENTRY_BYTES + len(chunk) + len(was)
            else:
                new.append(chunk)
        self.learn(new)
        out = []
        for chunks in cut:
            ids = array("i", b"".join(map(kept.__getitem__, chunks))).tolist()
            out.append((len(ids), " ".join(map(self.digits.__getitem__, ids)), " ".join(map(self.shown.__getitem__, ids))))
        return out


@lru_cache(1)
def tokenizer(path: str) -> Tokenizer:
    """One per Python worker."""
    return Tokenizer(path)


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", lasting: bool = True) -> DataFrame:
    """(id_col, n_tokens, ids, decoded): ids in decimal joined by one space, and their decoding.

    ``path`` names the tokenizer file, at the same place on every executor.
    Unless ``lasting``, a worker lets its kept results go after each task, so
    other work that it does next has the memory.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, TEXTS):
                part = batch.slice(lo, TEXTS)
                rows = t.encode([x or "" for x in part["text"].to_pylist()])
                columns = [part["id"], pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "n_tokens", "ids", "decoded"])
        if not lasting:
            t.forget()
            pa.default_memory_pool().release_unused()

    plain = docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text")
    return plain.mapInArrow(work, f"id {kind}, n_tokens bigint, ids string, decoded string").withColumnRenamed("id", id_col)

