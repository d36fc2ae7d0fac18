"""Evaluation passages inside training documents.

Both sides are reduced to words (runs of letters, lower case, joined by single spaces). A passage of
``min_words`` consecutive item words, up to ``edits`` of them changed, left out or with a word put before
them, lies in a document only if document and item share a certain number of character q-grams on
diagonals close to each other (q-gram lemma). Diagonals are counted in words, so a changed word moves none,
however long it is, and one put in or left out moves what follows by one. Each document counts its shared
q-grams in overlapping bands of diagonals, keeps the stretches that reach the item's bound, and verifies
all stretches of many documents together by one banded alignment over words.

The items are the bounded side: they are written in blocks of at most ``BLOCK_BYTES`` of text, which workers
read where they need them, and each block meets all documents in one pass without any shuffle. A document is
judged on its own, so items or sources that hold a third of all matches cost no more than others.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pandas as pd
import pyarrow.dataset as pads
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.plans.materialize import new_path
from barloom.sources.tables import require_columns

Q = 8
#: Text of the items of one index, in bytes; its tables take about 16 times as much of a worker's memory.
BLOCK_BYTES = 16_000_000
#: Text of the documents that are verified together, and shared q-grams that are spread over their items at once.
TOGETHER, SPREAD = 8_000_000, 4_000_000
#: Words that q - 1 letters and spaces touch at most: what a q-gram hides at either side of a change.
HIDDEN = (Q + 1) // 2 + 1
_BITS = 24
_COMMAND = re.compile(rb"\\[A-Za-z@]+\*?")
_FOREIGN_MARKS = re.compile(r"[^\w\x00-\x7f]+|[^\W\D0-9]+")
_LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
FOUND = "item_id long, doc_id long, words long, exact long, doc_word long, item_word long"


def plain_words(text: str) -> bytes:
    """Words of a text joined by single spaces, in UTF-8: commands go (their arguments stay), as do
    discretionary hyphens, digits, punctuation, comment signs and line breaks."""
    if not text.isascii():
        text = _FOREIGN_MARKS.sub(" ", text.replace("\xad", ""))
    raw = text.lower().encode("utf-8", "replace")
    if b"\\" in raw:
        raw = _COMMAND.sub(b" ", raw.replace(b"\\\\", b" ").replace(b"\\-", b""))
    return b" ".join(raw.translate(_LETTERS).split())


def _grams(plain: bytes) -> np.ndarray:
    """All q-grams (q is 8) as the numbers their bytes make, so that every alphabet tells them apart."""
    a = np.frombuffer(plain, np.uint8).astype(np.uint64)
    if len(a) < Q:
        return a[:0]
    two = a[:-1] | (a[1:] << np.uint64(8))
    four = two[:-2] | (two[2:] << np.uint64(16))
    return four[:-4] | (four[4:] << np.uint64(32))


def _word_of(plain: bytes) -> np.ndarray:
    """Number of the word each character belongs to; a space belongs to the word before it."""
    space = np.frombuffer(plain, np.uint8) == 32
    return np.cumsum(space) - space


def _slot(codes: np.ndarray) -> np.ndarray:
    return ((codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _BITS)).astype(np.int64)


def _joined(parts: list[np.ndarray], kind: type = np.int64) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, kind)


class ItemIndex:
    """Q-grams of a block of items: where each occurs, and each item's bound."""

    def __init__(self, ids: list[int], texts: list[str | None], min_words: int, edits: int):
        self.min_words, self.edits = min_words, edits
        self.ids, self.vocabulary = [], {}
        codes, item, word, bound, numbers = [], [], [], [], []
        for i, t in zip(ids, texts):
            plain = plain_words(t or "")
            words = plain.split()
            if len(words) < min_words:
                continue
            # Q-grams of the shortest passage that its longest words, were they changed, leave over.
            n = np.lib.stride_tricks.sliding_window_view(np.array([len(w) for w in words]), min_words)
            lost = np.sort(n, axis=1)[:, min_words - edits:] + Q
            bound.append(max(1, int((n.sum(axis=1) + min_words - Q - lost.sum(axis=1)).min())))
            g = _grams(plain)
            codes.append(g)
            item.append(np.full(len(g), len(self.ids), np.int32))
            word.append(_word_of(plain)[:len(g)].astype(np.int32))
            numbers.append(np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]))
            self.ids.append(i)
        self.bound, self.size = np.array(bound, np.int64), np.array([len(x) for x in numbers], np.int64)
        self.words, self.first_word = _joined(numbers), np.cumsum(self.size) - self.size
        # Shared q-grams of one passage follow each other at most so many words apart; words of the passage that have
        # none lie at most ``reach`` outside them.
        self.gap, self.reach = max(1, HIDDEN * edits + 1), HIDDEN * edits
        c = _joined(codes, np.uint64)
        order = np.argsort(c, kind="stable")
        c = c[order]
        self.item, self.word = _joined(item)[order], _joined(word)[order]
        self.code, self.first = np.unique(c, return_index=True)
        self.count = np.diff(np.append(self.first, len(c)))
        self.seen = np.zeros(1 << _BITS, bool)
        self.seen[_slot(self.code)] = True

    def regions(self, grams: np.ndarray, word_of: np.ndarray) -> np.ndarray:
        """(item, lowest and highest diagonal, first and last document word) of the stretches of a band whose shared
        q-grams reach the item's bound and span enough of its words; a diagonal is item word less document word."""
        none = np.zeros((0, 5), np.int64)
        at = np.flatnonzero(self.seen[_slot(grams)])
        if not len(at) or not self.ids:
            return none
        k = np.searchsorted(self.code, grams[at])
        k[k == len(self.code)] = 0
        ok = self.code[k] == grams[at]
        at, k = word_of[at[ok]], k[ok]
        # A stretch too short for any item at all ends here, before it is spread over the items.
        cut = np.flatnonzero(np.diff(at) > self.gap) + 1
        size = np.diff(np.concatenate(([0], cut, [len(at)])))
        ok = np.repeat(size >= self.bound.min(), size)
        at, k = at[ok], k[ok]
        if not len(at):
            return none
        # Stretches stand on their own: so many go together as fit in memory.
        n = self.count[k]
        ends = np.append(np.flatnonzero(np.diff(at) > self.gap) + 1, len(at))
        spread, parts, a = np.cumsum(n), [], 0
        while a < len(at):
            z = ends[max(np.searchsorted(ends, a, "right"), np.searchsorted(spread[ends - 1], (spread[a - 1] if a else 0) + SPREAD, "right") - 1)]
            parts.append(self._stretches(at[a:z], k[a:z], n[a:z]))
            a = z
        return np.concatenate(parts)

    def _stretches(self, at: np.ndarray, k: np.ndarray, n: np.ndarray) -> np.ndarray:
        word = np.repeat(at, n)
        o = np.repeat(self.first[k] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        item, diagonal = self.item[o].astype(np.int64), self.word[o] - word
        out = []
        # Bands are 2 x edits wide and lie half over each other, so that one holds any edits + 1 diagonals in a row.
        # Without edits a passage keeps to one diagonal, and so does its band.
        width = max(1, 2 * self.edits)
        for shift in (0, self.edits) if self.edits else (0,):
            key = (item << 40) + (diagonal + shift + (1 << 38)) // width
            order = np.lexsort((word, key))
            kk, ww, dd = key[order], word[order], diagonal[order]
            first = np.concatenate(([0], np.flatnonzero((np.diff(kk) != 0) | (np.diff(ww) > self.gap)) + 1))
            shared = np.diff(np.append(first, len(kk)))
            good = shared >= self.bound[kk[first] >> 40]
            if not good.any():
                continue
            dd, first, last = dd[np.repeat(good, shared)], first[good], (first + shared - 1)[good]
            it = kk[first] >> 40
            edge = np.cumsum(last - first + 1) - (last - first + 1)
            d0, d1 = np.minimum.reduceat(dd, edge), np.maximum.reduceat(dd, edge)
            lo = np.maximum(0, ww[first] + d0 - self.reach)
            hi = np.minimum(self.size[it], ww[last] + d1 + HIDDEN + self.reach + 1)
            enough = hi - lo >= self.min_words - self.edits
            out.append(np.stack([it, d0, d1, ww[first], ww[last]], axis=1)[enough])
        return np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 5), np.int64)

    def verify(self, words: np.ndarray, ends: np.ndarray, regions: np.ndarray) -> tuple[np.ndarray, ...]:
        """Banded alignment of every region: (passage found, item words matched with at most ``edits`` changes between
        them, longest run of equal words, document word and item word where the alignment ends).

        ``words`` are the numbers of the documents' words, those of a region's document ending at ``ends``; first and
        last document word and diagonals of ``regions`` count from the head of ``words``. An item word that the
        document changed or left out belongs to the passage, at its ends too; a word put in does not.
        """
        e, n = self.edits, len(regions)
        it, d0, d1 = regions[:, 0], regions[:, 1] - self.edits, regions[:, 2] + self.edits
        head = regions[:, 5]
        lo = np.maximum(head, regions[:, 3] - self.reach - 1)
        hi = np.minimum(ends, regions[:, 4] + self.reach + HIDDEN + 1)
        order = np.argsort(lo - hi, kind="stable")
        it, d0, d1, lo, hi = it[order], d0[order], d1[order], lo[order], hi[order]
        width = int((d1 - d0).max()) + 1
        size, base = self.size[it], self.first_word[it]
        cols = np.arange(width)
        known = cols[None, :] <= (d1 - d0)[:, None]
        # matched[k], whole[k]: best so far with at most k changes, by diagonal; whole counts changed item words too.
        matched, whole = np.zeros((e + 1, n, width), np.int64), np.zeros((e + 1, n, width), np.int64)
        best, exact, most = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        best_a, best_j = np.full(n, -1), np.full(n, -1)
        for step in range(int((hi - lo).max())):
            m = int(np.searchsorted(lo - hi, -step, "left"))
            a = lo[:m] + step
            j = a[:, None] + d0[:m, None] + cols
            ok = known[:m] & (j >= 0) & (j < size[:m, None])
            same = ok & (self.words[base[:m, None] + np.where(ok, j, 0)] == words[a][:, None])
            for state, counts in ((matched, 0), (whole, 1)):
                before = state[:, :m].copy()
                if counts:
                    for k in range(1, e + 1):
                        before[k] = np.maximum(before[k], np.clip(j, 0, k))
                now = np.where(same, before + 1, 0)
                for k in range(1, e + 1):
                    other = before[k - 1] + counts
                    other[:, :-1] = np.maximum(other[:, :-1], before[k - 1][:, 1:])
                    other[:, 1:] = np.maximum(other[:, 1:], now[k - 1][:, :-1] + counts)
                    now[k] = np.where(same, now[k], np.where(ok, other, 0))
                state[:, :m] = now
            top = matched[e, :m].max(axis=1)
            up = np.flatnonzero(top > best[:m])
            best[up], best_a[up] = top[up], a[up]
            best_j[up] = j[up, matched[e, up].argmax(axis=1)]
            exact[:m] = np.maximum(exact[:m], matched[0, :m].max(axis=1))
            most[:m] = np.maximum(most[:m], whole[e, :m].max(axis=1))
        back = np.empty(n, np.int64)
        back[order] = np.arange(n)
        # A stretch of words that only changes make long enough must still match in all but ``edits`` of them.
        found = (best >= self.min_words) | ((best >= self.min_words - e) & (most >= self.min_words))
        return found[back], best[back], exact[back], best_a[back], best_j[back]

    def search_all(self, texts: list[str | None]) -> pd.DataFrame:
        """Passages in many texts: text (its number), item (its number), words, exact, doc_word, item_word; one row per
        text and item, the one whose alignment is longest and, of equally long ones, ends last."""
        regions, numbers, base, get = [], [], 0, self.vocabulary.get
        for i, text in enumerate(texts):
            plain = plain_words(text) if text else b""
            if len(plain) < Q:
                continue
            r = self.regions(_grams(plain), _word_of(plain))
            if len(r):
                w = np.array([get(x, -1) for x in plain.split(b" ")])
                numbers.append(w)
                # Counted from the head of all words: document words move up, diagonals down.
                more = np.broadcast_to(np.array([base, base + len(w), i]), (len(r), 3))
                regions.append(np.concatenate([r + np.array([0, -base, -base, base, base]), more], axis=1))
                base += len(w)
        names = ["text", "item", "words", "exact", "doc_word", "item_word"]
        if not regions:
            return pd.DataFrame({x: np.zeros(0, np.int64) for x in names})
        r = np.concatenate(regions)
        found, words, exact, a, j = self.verify(np.concatenate(numbers), r[:, 6], r)
        f = pd.DataFrame({"text": r[:, 7], "item": r[:, 0], "words": words, "exact": exact, "doc_word": a - r[:, 5], "item_word": j})[found]
        f["exact"] = f.groupby(["text", "item"])["exact"].transform("max")
        return f.sort_values(names[:3] + names[4:]).drop_duplicates(["text", "item"], keep="last")

    def search(self, text: str | None) -> dict[int, tuple[int, int, int]]:
        """Items (by number) of which one text holds a passage: words, document word and item word of its end."""
        return {i: (w, a, j) for _, i, w, _, a, j in self.search_all([text]).itertuples(index=False)}


def _read_items(path: str, block: int) -> tuple[list[int], list[str]]:
    at = urlparse(path)
    fs, root = (pyarrow.fs.LocalFileSystem(), at.path) if at.scheme in ("", "file") else pyarrow.fs.FileSystem.from_uri(path)
    t = pads.dataset(f"{root}/block={block}", filesystem=fs, format="parquet").to_table(columns=["item_id", "text"]).sort_by("item_id")
    return t["item_id"].to_pylist(), t["text"].to_pylist()


def leaked_items(
    documents: DataFrame, items: DataFrame, min_words: int = 12, edits: int = 1, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per document and leaked item (FOUND): item words matched, the longest run of equal words (exact), and
    where in document and item the passage ends, counted in words from 0. A passage has ``min_words`` consecutive item
    words of which ``edits`` may be changed, left out or have a word put before them, so fewer than ``min_words`` may
    match; ``exact`` tells passages without any change.

    Null and empty texts, and items shorter than ``min_words`` words, leak nothing. Repeated documents
    give repeated rows; an empty table on either side gives no rows; other columns are ignored. Whole
    texts are searched, whatever their length, in any alphabet.
    """
    require_columns(documents, {"doc_id", "text"})
    require_columns(items, {"item_id", "text"})
    if not 0 <= edits < min_words:
        raise ValueError("fewer edits than words")
    spark = documents.sparkSession
    items = items.select("item_id", "text").where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).distinct()
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_bytes))
    path = new_path(spark, "items")
    items.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks))).write.partitionBy("block").parquet(path)
    out = spark.createDataFrame([], FOUND)
    passes = [r["block"] for r in spark.read.parquet(path).select("block").distinct().collect()] if total else []
    for b in passes:
        def run(batches: Iterator[pd.DataFrame], b=b) -> Iterator[pd.DataFrame]:
            index = None
            for batch in batches:
                index = index or ItemIndex(*_read_items(path, b), min_words, edits)
                together = np.cumsum(batch["text"].str.len().fillna(0).to_numpy()) // TOGETHER
                for _, part in batch.groupby(together):
                    f = index.search_all(part["text"].tolist())
                    f["item_id"] = np.array(index.ids, np.int64)[f["item"].to_numpy()] if len(f) else np.zeros(0, np.int64)
                    f["doc_id"] = part["doc_id"].to_numpy()[f["text"].to_numpy()]
                    yield f[[x.split()[0] for x in FOUND.split(", ")]]

        p = documents.select("doc_id", "text").where(F.col("doc_id").isNotNull()).mapInPandas(run, FOUND)
        out = p if b == passes[0] else out.unionByName(p)
    return out
