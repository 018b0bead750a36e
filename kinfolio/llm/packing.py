"""Order-preserving packing of token streams by dynamic programming."""

from __future__ import annotations

import heapq
import json
import re
from array import array
from bisect import bisect_left
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import only, table

#: How byte-level BPE splits a text into pieces, as regular expression.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Costs, in tokens of padding: a cut between sentences, and one inside a sentence.
SENTENCE_CUT, HARD_CUT = 4, 24
#: A stretch without a sentence end can be cut at every so many tokens.
HARD_STEP = 64
#: Lengths below the largest at which a sequence needs no padding.
UNPADDED = (128, 256, 512)
#: Characters of white space in a row from which ``tokenizers`` encodes a text.
BLANK_RUN = 10_000
_BLANKS, _FAR_BLANKS = re.compile(r"\s+"), re.compile(rf"\s{{{BLANK_RUN // 100}}}")
#: Bytes of text that are encoded at once, each different word among them once.
AT_ONCE = 4 << 20
#: A space that doesn't begin a word.
_LOOSE = re.compile(r" (?!\S)")


def tokenizer_path(name: str) -> str:
    """Where a vocabulary file lies on this machine; a path stays as it is."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of a byte-level BPE vocabulary file of ``tokenizers``.

    Texts that hold the name of a special token, or a run of white space so long that
    the other's pattern would exhaust its stack, go to ``tokenizers`` itself; all
    others to the same vocabulary in ``tiktoken``, which is several times faster
    and gives the same ids.
    """

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        code = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(sorted({*range(256)} - {*shown}))}
        self.special = [t["content"] for t in spec.get("added_tokens", ())]
        ranks = {bytes(code[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.plain = tiktoken.Encoding("file", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.path, self.slow = path, None
        most = max(spec["model"]["vocab"].values()) + 2
        self.sentence_end, self.n_bytes = np.zeros(most, bool), np.zeros(most, np.int64)
        for t, i in ranks.items():
            self.sentence_end[i] = t.rstrip(b" \"')")[-1:] in (b".", b"!", b"?") or b"\n" in t
            self.n_bytes[i] = len(t)

    def _slowly(self, text: str) -> bool:
        """Whether ``tokenizers`` has to encode the text; a long run of white space shows in every hundredth character."""
        if any(t in text for t in self.special):
            return True
        return len(text) >= BLANK_RUN and bool(_FAR_BLANKS.search(text[99::100])) and any(m.end() - m.start() >= BLANK_RUN for m in _BLANKS.finditer(text))

    def __call__(self, text: str) -> list[int]:
        if self._slowly(text):
            if self.slow is None:
                from tokenizers import Tokenizer

                self.slow = Tokenizer.from_file(self.path)
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.plain(text)

    def many(self, texts: list[str], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, ``end_id`` after each, and how many each text has, that one included.

        A space before anything but white space always begins a piece, so what lies
        between two of them, a word here, has the same ids wherever it stands. All
        different words are encoded as one string; the bytes of their ids tell where
        each ends. Other spaces are zero bytes meanwhile; texts that hold this byte,
        or that ``tokenizers`` has to encode, are encoded whole.
        """
        whole = ["\0" in t or self._slowly(t) for t in texts]
        hidden = ["" if w else _LOOSE.sub("\0", t) for w, t in zip(whole, texts, strict=True)]
        heads = [t.partition(" ")[0] for t in hidden]  # may begin with white space, so they are no words; "a" holds their place
        split = pc.split_pattern(pa.array(["a" + t[len(h) :] for h, t in zip(heads, hidden, strict=True)], pa.string()), " ")
        coded, bounds = split.flatten().dictionary_encode(), split.offsets.to_numpy().astype(np.int64)
        words, seq, first = coded.dictionary, coded.indices.to_numpy().astype(np.int64), bounds[:-1]
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), " ")[0].as_py()
        ids = np.frombuffer(array("I", self.plain(" " + joined.replace("\0", " "))), np.uint32)
        word_stops = np.searchsorted(np.cumsum(self.n_bytes[ids]), np.cumsum(pc.binary_length(words).to_numpy() + 1)) + 1
        alone, upto = array("I"), []
        for w, h, t in zip(whole, heads, texts, strict=True):
            alone.extend(self(t) if w else self.plain(h.replace("\0", " ")))
            upto.append(len(alone))
        alone.append(end_id)
        known = np.concatenate((ids, np.array(alone)))
        stops = np.concatenate((word_stops, len(ids) + np.array([*upto, len(alone)])))
        seq[first] = len(words) + np.arange(len(texts))
        seq = np.insert(seq, bounds[1:], len(stops) - 1)
        n = np.diff(stops, prepend=0)[seq]
        upto = np.cumsum(n)
        out = known[np.repeat(stops[seq] - upto, n) + np.arange(upto[-1])]
        return out, np.diff(upto[bounds[1:] + np.arange(len(texts))], prepend=0)


class Packer:
    """Cuts a stream of tokens into sequences at least cost.

    Cuts can stand where documents or sentences end, and, dearer, inside long
    sentences. The cost of a sequence is its padding plus its cut. For a fixed
    end the padding falls as the start moves left, so the best start is the
    front of a queue of starts kept in rising cost; an end costs amortised O(1),
    plus one look-up for each unpadded length. What all open paths share is
    final and leaves at once, so memory doesn't grow with the stream.
    """

    def __init__(self, most: int) -> None:
        self.most, self.unpadded = most, tuple(n for n in UNPADDED if n < most)
        self.pos, self.cost, self.back = [0], [0], [-1]  # of each cut; the first is final
        self.key, self.queue = [0], deque([0])  # position plus cost

    def add(self, positions: list[int], penalties: list[int]) -> None:
        """Positions follow the ones before, at most ``most`` apart."""
        pos, cost, back, key, queue, most = self.pos, self.cost, self.back, self.key, self.queue, self.most
        j, old, at = len(pos), bisect_left(pos, pos[-1] - most), np.array(positions, np.int64)
        near, starts = np.concatenate((np.array(pos[old:], np.int64), at)), at[:, None] - np.array(self.unpadded, np.int64)
        found = np.searchsorted(near, starts)
        hit = near[found] == starts
        filled = iter((found[hit] + old).tolist())  # starts of unpadded sequences, by end
        for p, penalty, n_filled in zip(positions, penalties, hit.sum(axis=1).tolist(), strict=True):
            low = p - most
            while pos[queue[0]] < low:
                queue.popleft()
            i = queue[0]
            best = key[i] - low
            for _ in range(n_filled) if n_filled else ():
                k = next(filled)
                if cost[k] < best:
                    best, i = cost[k], k
            best += penalty
            mine = best + p
            while queue and key[queue[-1]] >= mine:
                queue.pop()
            queue.append(j)
            pos.append(p)
            cost.append(best)
            key.append(mine)
            back.append(i)
            j += 1

    def final(self, end: bool = False) -> list[int]:
        """Cuts that can't change any more (all, at the ``end``), and forgets them."""
        pos, back = self.pos, self.back
        if end:
            at = len(pos) - 1
        else:
            live = {*range(bisect_left(pos, pos[-1] - self.most), len(pos))}
            heap = [-i for i in live]
            heapq.heapify(heap)
            while len(heap) > 1:
                i = back[-heapq.heappop(heap)]
                if i not in live:
                    live.add(i)
                    heapq.heappush(heap, -i)
            at = -heap[0]
        cuts, i = [], at
        while i > 0:
            cuts.append(pos[i])
            i = back[i]
        self.pos, self.cost, self.key, self.back = pos[at:], self.cost[at:], self.key[at:], [max(-1, i - at) for i in back[at:]]
        self.queue = deque(i - at for i in self.queue if i >= at)
        return cuts[::-1]


def _cuts(ids: np.ndarray, sizes: np.ndarray, sentence_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where texts of these sizes can be cut, the end of each included, and the penalties there."""
    doc_ends, ends = np.cumsum(sizes), sentence_end.take(ids, mode="clip")  # any id may end a document
    ends[doc_ends - 1] = True
    at = np.flatnonzero(ends) + 1
    gaps = np.diff(at, prepend=0)
    n = (gaps - 1) // HARD_STEP + 1
    last = np.cumsum(n) - 1
    cuts = np.repeat(at - gaps, n) + HARD_STEP * (np.arange(n.sum()) - np.repeat(last - n, n))
    penalties = np.full(len(cuts), HARD_CUT)
    cuts[last], penalties[last] = at, SENTENCE_CUT
    penalties[np.searchsorted(cuts, doc_ends)] = 0
    return cuts, penalties


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose texts have ``AT_ONCE`` bytes together, or one."""
    for batch in batches:
        upto = np.cumsum([0, *pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()])
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(upto, upto[a] + AT_ONCE, side="right")) - 1)
            yield batch.slice(a, b - a)
            a = b


def _pack(batches: Iterator[pa.RecordBatch], path: str, most: int, end_id: int, id_type: pa.DataType, per_flush: int) -> Iterator[pa.RecordBatch]:
    encode, packer = Encoder(tokenizer_path(path)), Packer(most)
    sequence = TaskContext.get().partitionId() << 33
    base, ids = 0, np.zeros(0, np.uint32)  # ids from position ``base`` on, where a sequence starts
    docs: list = []  # doc_id of what isn't out yet; its first position and tokens
    starts = sizes = np.zeros(0, np.int64)

    def flush(end: bool) -> pa.RecordBatch | None:
        nonlocal base, ids, docs, starts, sizes, sequence
        cuts = packer.final(end)
        if not cuts:
            return None
        stop = cuts[-1]
        edges = np.unique(np.concatenate((starts[(starts > base) & (starts < stop)], [base], cuts)))
        a, b = edges[:-1], edges[1:]
        which = np.searchsorted(starts, a, side="right") - 1
        seqs = np.searchsorted(cuts, a, side="right")
        first = starts[which]
        offsets = pa.array(4 * (edges - base), pa.int32())
        out = pa.record_batch({
            "doc_id": pa.array([docs[w] for w in which.tolist()], id_type),
            "start": a - first, "length": b - a,
            "ids": pa.Array.from_buffers(pa.binary(), len(a), [None, offsets.buffers()[1], pa.py_buffer(ids[: stop - base])]),
            "doc_tokens": sizes[which], "sequence_id": sequence + seqs, "offset": a - np.concatenate(([base], cuts))[seqs],
        })
        left = int(np.searchsorted(starts + sizes, stop, side="right"))
        docs, starts, sizes = docs[left:], starts[left:], sizes[left:]
        sequence, base, ids = sequence + len(cuts), stop, ids[stop - base :]
        return out

    waiting = 0
    for part in _parts(batches):
        own, n = encode.many([t or "" for t in part.column(1).to_pylist()], end_id)
        total = base + len(ids)
        at, penalties = _cuts(own, n, encode.sentence_end)
        packer.add((at + total).tolist(), penalties.tolist())
        docs += part.column(0).to_pylist()
        starts, sizes = np.concatenate((starts, total + np.cumsum(n) - n)), np.concatenate((sizes, n))
        ids = np.concatenate((ids, own))
        waiting += len(own)
        if waiting >= per_flush:
            waiting = 0
            if (out := flush(False)) is not None:
                yield out
    if docs and (out := flush(True)) is not None:
        yield out


def pack(documents: DataFrame, *, tokenizer: str = "byte_bpe_50k.json", most: int = 1024, end_id: int = 0, per_flush: int = 500_000) -> DataFrame:
    """Packs documents into sequences of at most ``most`` tokens.

    Each partition packs its own rows in their order; nothing is shuffled, and
    no sequence crosses a partition. A document is its ids and then ``end_id``; a
    null text is empty, so it is ``end_id`` alone. Sequences are padded to
    ``most`` unless their length is 128, 256 or 512.

    Returns a row for each piece of a document: doc_id, start (its document's
    ids before it), length, ids (little-endian unsigned 32-bit), doc_tokens,
    sequence_id, offset (of the piece there). Each row of ``documents`` is a
    document of its own, also if ids repeat or are null. Long texts are cut over
    as many sequences as they need. An empty table gives an empty result.
    """
    docs = only(documents)
    kind = docs.schema["doc_id"].dataType.simpleString()
    arrow = to_arrow_type(docs.schema["doc_id"].dataType)
    schema = f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return docs.mapInArrow(lambda batches: _pack(batches, tokenizer, most, end_id, arrow, per_flush), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES, ORACLES = {"op6_pack_sequences": query}, {}
