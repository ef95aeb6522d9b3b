"""Operator 3: SentencePiece (BPE) encoding and decoding by vectorised merge rounds.

A text is cut where no piece of the vocabulary can reach across (before a space symbol that follows
another character; around a line break if no longer piece holds one). The distinct words of a batch
lie in one flat array of symbols. Each round looks up the rank of every neighbouring pair, takes the
smallest rank of each word (a segmented minimum), merges there, leftmost first, in all words at once,
and compacts the array; words in which no pair is left leave it. Where merging one pair could open a
better one, a word merges only its leftmost place in that round, which keeps the order that a single
priority queue would have. Characters without a piece become byte pieces. A round passes over a whole word, so
a word of more than ``LONG`` characters (text without spaces) is merged from such a queue instead.

The vocabulary (some 32,000 pieces) is read once on the driver and is sent to the executors; they need
no tokenizer file. Each worker keeps a bounded memory of words that it has already encoded.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm.tables import table

META = "▁"
#: Characters of a word beyond which its pairs are kept in a queue.
LONG = 256
#: Longest word that a worker remembers.
KEPT = 64
NONE = np.int32(2**31 - 1)


class PieceModel:
    """A BPE vocabulary: pair table, ranks, byte pieces. ``load`` reads a model file."""

    def __init__(self, pieces: list[str], scores: list[float], kinds: list[str], bos: int, eos: int):
        self.pieces, self.bos, self.eos, self.size = pieces, bos, eos, len(pieces)
        normal = {p: i for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)) if k == "normal"}
        order = {s: r for r, s in enumerate(sorted({scores[i] for i in normal.values()}, reverse=True))}
        self.rank = np.full(self.size, NONE, dtype=np.int32)
        for i in normal.values():
            self.rank[i] = order[scores[i]]
        self.byte_id = np.zeros(256, dtype=np.uint32)
        for i, k in enumerate(kinds):
            if k == "byte":
                self.byte_id[int(pieces[i][3:5], 16)] = i
        self.chars = {ord(p): i for p, i in normal.items() if len(p) == 1}
        pairs = {normal[p[:k]] * self.size + normal[p[k:]]: i for p, i in normal.items() for k in range(1, len(p)) if p[:k] in normal and p[k:] in normal}
        self.pair_key = np.array(sorted(pairs), dtype=np.int64)
        self.pair_piece = np.array([pairs[k] for k in sorted(pairs)], dtype=np.int32)
        # the best rank of any pair that a piece is part of
        best = np.full(self.size, NONE, dtype=np.int32)
        if len(self.pair_key):
            np.minimum.at(best, self.pair_key // self.size, self.rank[self.pair_piece])
            np.minimum.at(best, self.pair_key % self.size, self.rank[self.pair_piece])
        self.safe = best > self.rank
        held = [bytes([int(pieces[i][3:5], 16)]) if k == "byte" else b"" if k == "control" else "⁇".encode() if k == "unknown" else p.replace(META, " ").encode() for i, (p, k) in enumerate(zip(pieces, kinds, strict=True))]
        if "unknown" in kinds:
            held[kinds.index("unknown")] = " ⁇ ".encode()
        self.piece_len = np.array([len(b) for b in held], dtype=np.int64)
        self.piece_at = np.concatenate([[0], np.cumsum(self.piece_len)])[:-1]
        self.piece_bytes = np.frombuffer(b"".join(held), dtype=np.uint8)
        self.lead = np.array([p.startswith(META) and k == "normal" for p, k in zip(pieces, kinds, strict=True)])
        self.digest = hashlib.sha256(repr((pieces, scores, kinds, bos, eos)).encode()).hexdigest()
        self.control = np.array([k == "control" for k in kinds])
        cut_line = not any("\n" in p for p in normal)
        if any(META in p.lstrip(META) for p in normal):
            raise ValueError("pieces reach across spaces; this vocabulary can't be cut into words")
        self.word = re.compile(f"\n|{META}*[^{META}\n]+|{META}+" if cut_line else f"{META}*[^{META}]+|{META}+")

    @classmethod
    def load(cls, path: str) -> PieceModel:
        """Read a BPE model with byte pieces, identity normalisation and a leading space symbol."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        if sp.normalize(" a  Äﬁ") != f"{META}{META}a{META}{META}Äﬁ" or any(sp.is_unused(i) for i in range(n)):
            raise ValueError(f"{path}: only identity normalisation with a leading space is supported")
        kind = lambda i: "unknown" if sp.is_unknown(i) else "control" if sp.is_control(i) else "byte" if sp.is_byte(i) else "normal"
        return cls([sp.id_to_piece(i) for i in range(n)], [sp.get_score(i) for i in range(n)], [kind(i) for i in range(n)], sp.bos_id(), sp.eos_id())

    def lut(self) -> np.ndarray:
        if not hasattr(self, "_lut"):
            self._lut = np.full(0x110000, -1, dtype=np.int32)
            self._lut[list(self.chars)] = list(self.chars.values())
        return self._lut

    def pair_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Piece that a pair of symbols merges to, or -1."""
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        return np.where((self.pair_key[at] == key) & (left >= 0) & (right >= 0), self.pair_piece[at], -1)

    def merged_long(self, sym: list[int]) -> list[int]:
        """All merges of one word from a queue: best rank first, then leftmost."""
        if not hasattr(self, "_pairs"):
            self._pairs = dict(zip(self.pair_key.tolist(), self.pair_piece.tolist(), strict=True))
            self._ranks = self.rank.tolist()
        pairs, ranks, size, n = self._pairs, self._ranks, self.size, len(sym)
        before, after, gone = list(range(-1, n - 1)), list(range(1, n + 1)), -(1 << 40)
        queue: list[tuple[int, int, int, int, int]] = []

        def push(i: int) -> None:
            j = after[i]
            if j < n and sym[i] >= 0 and sym[j] >= 0 and (p := pairs.get(sym[i] * size + sym[j])) is not None:
                heapq.heappush(queue, (ranks[p], i, p, sym[i], sym[j]))

        for i in range(n - 1):
            push(i)
        while queue:
            _, i, p, a, b = heapq.heappop(queue)
            j = after[i]
            if sym[i] != a or j >= n or sym[j] != b:
                continue
            sym[i], sym[j] = p, gone
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        return [s for s in sym if s != gone]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of each word (little-endian unsigned 32-bit), without begin and end."""
        if not words:
            return []
        cp = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        sym = self.lut()[cp].astype(np.int64)
        sym = np.where(sym < 0, -1 - cp.astype(np.int64), sym)
        done_sym, done_word = [], []
        if (long := [i for i, w in enumerate(words) if len(w) > LONG]):
            first = np.searchsorted(word, [long, [i + 1 for i in long]])
            for i, a, b in zip(long, *first.tolist(), strict=True):
                done_sym.append(np.array(self.merged_long(sym[a:b].tolist()), dtype=np.int64))
                done_word.append(np.full(len(done_sym[-1]), i))
            rest = ~np.isin(word, long)
            sym, word = sym[rest], word[rest]

        def looked_up(i: np.ndarray) -> None:
            """Refresh the pairs that start at positions i."""
            nxt = np.minimum(i + 1, len(sym) - 1)
            p = np.where((word[nxt] == word[i]) & (nxt > i), self.pair_of(sym[i], sym[nxt]), -1)
            merged[i] = p
            rank[i] = np.where(p >= 0, self.rank[p], NONE)

        merged, rank = np.empty(len(sym), dtype=np.int32), np.empty(len(sym), dtype=np.int32)
        looked_up(np.arange(len(sym)))
        while len(sym):
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            length = np.diff(np.append(first, len(sym)))
            low = np.minimum.reduceat(rank, first)
            over = low == NONE
            if over.any():
                out = np.repeat(over, length)
                done_sym.append(sym[out])
                done_word.append(word[out])
                sym, word, merged, rank = sym[~out], word[~out], merged[~out], rank[~out]
                if not len(sym):
                    break
                length, low = length[~over], low[~over]
            hit = np.flatnonzero(rank == np.repeat(low, length))
            lead = np.concatenate([[True], word[hit[1:]] != word[hit[:-1]]])
            hit = hit[lead | self.safe[merged[hit]]]
            # of places that overlap, every second one, from the left
            run = np.flatnonzero(np.concatenate([[True], hit[1:] != hit[:-1] + 1]))
            nth = np.arange(len(hit)) - np.repeat(run, np.diff(np.append(run, len(hit))))
            hit = hit[nth % 2 == 0]
            sym[hit] = merged[hit]
            keep = np.ones(len(sym), dtype=bool)
            keep[hit + 1] = False
            at = hit - np.arange(len(hit))
            sym, word, merged, rank = sym[keep], word[keep], merged[keep], rank[keep]
            looked_up(np.unique(np.concatenate([at, np.maximum(at - 1, 0)])))
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        sym, word = sym[order], word[order]
        if (odd := np.flatnonzero(sym < 0)).size:
            raw = [chr(-1 - s).encode() for s in sym[odd].tolist()]
            n = np.ones(len(sym), dtype=np.int64)
            n[odd] = [len(b) for b in raw]
            start = np.cumsum(n) - n
            sym, word = np.repeat(sym, n), np.repeat(word, n)
            flat = np.repeat(start[odd], n[odd]) + np.concatenate([np.arange(k) for k in n[odd]])
            sym[flat] = self.byte_id[np.frombuffer(b"".join(raw), dtype=np.uint8)]
        ids = sym.astype("<u4").tobytes()
        ends = np.searchsorted(word, np.arange(len(words) + 1)) * 4
        return [ids[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

    def decode(self, ids: np.ndarray) -> str:
        """Text of some ids, as the library's decode gives it: control ids are silent, the leading space goes, stray bytes become U+FFFD."""
        ids = ids[~self.control[ids]].astype(np.int64)
        if not len(ids):
            return ""
        n = self.piece_len[ids]
        flat = np.repeat(self.piece_at[ids] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        raw = self.piece_bytes[flat].tobytes()
        return (raw[1:] if self.lead[ids[0]] else raw).decode("utf-8", "one_each")


def _one_each(e: UnicodeError):
    return "�" * (e.end - e.start), e.end


#: Words encoded before, by the digest of the model: a worker may serve several.
_known: dict[str, dict[str, bytes]] = {}


def encode_texts(model: PieceModel, texts: list[str], known: dict[str, bytes] | None = None, most_known: int = 150_000) -> list[bytes]:
    """Ids of whole texts with begin and end. known: words of up to KEPT characters encoded before; it is emptied when it outgrows most_known."""
    known = _known.setdefault(model.digest, {}) if known is None else known
    if len(known) > most_known:
        known.clear()
    split = [model.word.findall(META + t.replace(" ", META)) if t else [] for t in texts]
    new = list({w for ws in split for w in ws} - known.keys())
    made = dict(zip(new, model.encode_words(new), strict=True))
    known.update((w, b) for w, b in made.items() if len(w) <= KEPT)
    begin, end = (np.array([i], dtype="<u4").tobytes() for i in (model.bos, model.eos))
    if any(len(w) > KEPT for w in new):
        return [b"".join([begin, *(known.get(w) or made[w] for w in ws), end]) for ws in split]
    return [b"".join([begin, *map(known.__getitem__, ws), end]) for ws in split]


def with_pieces(docs: DataFrame, model: PieceModel, key: str = "doc_id", text: str = "text", batch_bytes: int = 1 << 20) -> DataFrame:
    """``(key, n_tokens, ids, decoded)`` for each row: ids binary, little-endian unsigned 32-bit, with begin and end.

    A null text counts as empty: two ids, decoded to "". Rows with equal or null keys each give a row.
    Further columns are ignored. Texts are whole, whatever their length.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import codecs

        codecs.register_error("one_each", _one_each)
        for pdf in batches:
            texts = [t if isinstance(t, str) else "" for t in pdf["t"]]
            at = held = 0
            for i, t in enumerate([*texts, None]):
                if t is None or held > batch_bytes:
                    if i > at:
                        ids = encode_texts(model, texts[at:i])
                        yield pd.DataFrame({"k": pdf["k"].iloc[at:i].to_numpy(), "n_tokens": [len(b) // 4 for b in ids], "ids": ids, "decoded": [model.decode(np.frombuffer(b, dtype="<u4")) for b in ids]})
                    at, held = i, 0
                held += len(t or "")

    out = docs.select(F.col(key).cast("string").alias("k"), F.col(text).alias("t")).mapInPandas(run, "k string, n_tokens long, ids binary, decoded string")
    return out.select(F.col("k").cast(docs.schema[key].dataType).alias(key), "n_tokens", "ids", "decoded")


def op3_pieces(spark: SparkSession, sf_dir: str, model_path: str | None = None) -> DataFrame:
    if model_path is None:
        import public_tokenizers

        model_path = public_tokenizers.path("piece_bpe_32k.model")
    out = with_pieces(table(spark, sf_dir, "documents"), PieceModel.load(model_path))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))
