"""Documents into windows of fixed capacity.

Karmarkar-Karp multiway differencing: every document starts as a partial partition of its own; the two
partitions whose windows differ most are merged, fullest windows against emptiest, until one is left with
near-equal windows. Windows beyond the capacity then exchange documents with windows that have room; only
while some window still exceeds the capacity does the number of windows rise.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.tokens import count_tokens
from barloom.plans.materialize import written
from barloom.sources.tables import require_columns

CAPACITY = 4096
#: Documents that one task packs together; each such group leaves at most about one window part-filled.
GROUP = 2000
PACKED = "window_id long, doc_id long, piece_no int, token_from long, token_to long"


def differencing(sizes: np.ndarray, k: int) -> list[list[int]]:
    """Item numbers of k near-equal windows. A partition holds its non-empty windows, fullest first."""
    heap = [(-int(s), i, np.array([s], np.int64), [[i]]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    n = len(heap)
    while len(heap) > 1:
        _, _, a, ga = heapq.heappop(heap)
        _, _, b, gb = heapq.heappop(heap)
        if len(a) + len(b) <= k:
            sums, groups = np.concatenate([a, b]), ga + gb
        else:
            sums = np.zeros(k, np.int64)
            sums[:len(a)] = a
            sums[k - len(b):] += b[::-1]
            groups = ga + [[] for _ in range(k - len(ga))]
            for j, g in enumerate(gb):
                groups[k - 1 - j] = groups[k - 1 - j] + g
        order = np.argsort(-sums, kind="stable")
        sums, groups = sums[order], [groups[j] for j in order]
        low = int(sums[-1]) if len(sums) == k else 0
        heapq.heappush(heap, (low - int(sums[0]), n, sums, groups))
        n += 1
    return heap[0][3] + [[] for _ in range(k - len(heap[0][3]))]


def exchange(sizes: np.ndarray, groups: list[list[int]], capacity: int) -> bool:
    """Swaps or moves items out of windows beyond the capacity, each time the exchange that lowers the
    excess most and of these the one that leaves least room in the other window. True if no window
    exceeds the capacity any more."""
    window = np.empty(len(sizes), np.int64)
    for g, items in enumerate(groups):
        window[items] = g
    load = np.bincount(window, sizes, len(groups)).astype(np.int64)
    # Behind the items one empty place per window: to swap with it is to move there.
    ids = np.arange(len(sizes))
    while (over := int(load.max()) - capacity) > 0:
        w = int(load.argmax())
        mine = ids[window == w]
        partner_size = np.concatenate([sizes, np.zeros(len(groups), np.int64)])
        partner_window = np.concatenate([window, np.arange(len(groups))])
        d = sizes[mine][:, None] - partner_size[None, :]
        room = capacity - load[partner_window]
        lower = np.minimum(over, d) - np.maximum(0, d - room)
        lower = np.where((d > 0) & (room > 0) & (partner_window != w), lower, 0)
        best = int(lower.max())
        if best <= 0:
            return False
        left = np.where(lower == best, np.abs(room - d), np.iinfo(np.int64).max)
        i, j = np.unravel_index(int(left.argmin()), left.shape)
        x, v = mine[i], int(partner_window[j])
        load[w] -= d[i, j]
        load[v] += d[i, j]
        window[x] = v
        if j < len(sizes):
            window[j] = w
    for g in groups:
        g.clear()
    for x, g in enumerate(window.tolist()):
        groups[g].append(x)
    return True


def pack(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Windows of item numbers for items of at most the capacity."""
    sizes = np.asarray(sizes, np.int64)
    if not len(sizes):
        return []
    low, step, found = max(1, -(-int(sizes.sum()) // capacity)), 1, None
    high = low
    while found is None:
        groups = differencing(sizes, high)
        if exchange(sizes, groups, capacity):
            found = groups
        else:
            low, high, step = high + 1, high + step, step * 2
    while low < high:
        # Between a number that failed and one that did not, whichever fits and is less.
        k = (low + high) // 2
        groups = differencing(sizes, k)
        if exchange(sizes, groups, capacity):
            high, found = k, groups
        else:
            low = k + 1
    return [g for g in found if g]


def pack_documents(
    documents: DataFrame, tokenizer: str = "byte_bpe_50k", folder: str = "/opt/tokenizers", capacity: int = CAPACITY, group: int = GROUP,
) -> DataFrame:
    """Windows of at most ``capacity`` tokens (PACKED and tokenizer): one row per document, or per piece of
    a document longer than that. Such a document fills whole windows of its own; only what is left of it
    is packed with others. A null or empty text has no tokens and takes a place in some window. Repeated
    rows are packed as often as they occur; an empty table gives no rows; other columns are ignored.

    Texts are tokenized where they are read and never shuffled: only (doc_id, tokens) travels. Packing
    groups are drawn by hash of the row, so they stay near ``group`` documents whatever a source's share and however
    often one id is repeated.
    """
    require_columns(documents, {"doc_id", "text"})
    counted = documents.select("doc_id", count_tokens(F.col("text"), tokenizer, folder).alias("tokens"))
    sized = written(counted.withColumn("row_", F.monotonically_increasing_id()), "tokens")
    groups = max(1, round(sized.count() / group))
    at = F.pmod(F.xxhash64("doc_id", "row_", F.lit(7)), F.lit(groups))

    def run(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(["tokens", "doc_id"], ascending=[False, True], kind="stable")
        doc, tokens = b["doc_id"].to_numpy(), b["tokens"].to_numpy(np.int64)
        full = np.where(tokens > capacity, tokens // capacity, 0)
        base, n_full = int(b["packing_group"].iloc[0]) << 32, int(full.sum())
        owner = np.repeat(np.arange(len(doc)), full)
        piece = np.arange(n_full) - np.repeat(np.cumsum(full) - full, full)
        out = [pd.DataFrame({
            "window_id": base + np.arange(n_full), "doc_id": doc[owner], "piece_no": piece.astype(np.int32),
            "token_from": piece * capacity, "token_to": (piece + 1) * capacity})]
        rest = tokens - full * capacity
        items = np.flatnonzero((rest > 0) | (tokens == 0))
        for w, members in enumerate(pack(rest[items], capacity)):
            m = items[members]
            out.append(pd.DataFrame({
                "window_id": base + n_full + w, "doc_id": doc[m], "piece_no": full[m].astype(np.int32),
                "token_from": full[m] * capacity, "token_to": tokens[m]}))
        return pd.concat(out)

    # A number of partitions of our own: by their few bytes adaptive execution would join all groups into one task.
    out = sized.withColumn("packing_group", at).drop("row_").repartition(min(groups, 20_000), "packing_group")
    out = out.groupBy("packing_group").applyInPandas(run, PACKED)
    return out.withColumn("tokenizer", F.lit(tokenizer))
