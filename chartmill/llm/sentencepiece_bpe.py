"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

No piece of the model holds a space mark after another character or a newline, so merges never cross from one word
(with the spaces before it) to the next. A batch is cut into such words, each distinct word is encoded once, and
all new words of a batch are encoded together: one flat array of symbols with word numbers, in rounds. A round finds
the best pair of each word (a segmented minimum of pair ranks), merges its leftmost occurrences at once, and compacts
the arrays; words without a pair leave. An occurrence whose merge would open a pair at least as good ends the round for its
word, since the library would take that pair first; so the ids equal the library's.

Defined cases: a null text counts as empty; an empty text has the begin and end ids alone; a text of any length is
encoded whole. Rows are independent, so repeated rows and extra columns are kept as they are.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import beside, blocks

SPACE = "▁"
NONE = np.int64(1 << 40)
#: Characters of the words kept per Python worker, with what keeping a word costs; the store is emptied when it is full. Longer words aren't kept.
CACHE_CHARS, WORD_COST, KEPT_CHARS = 60_000_000, 100, 200
#: Characters of text whose words are held at once.
BLOCK_CHARS = 1_000_000


class Bpe:
    """The pieces of a model, and encoding of words in batches."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(size)]
        self.bos, self.eos = sp.bos_id(), sp.eos_id()
        self.byte_ids = np.zeros(256, np.int64)
        ids: dict[str, int] = {}
        self.surface: list[bytes] = [b""] * size
        self.is_byte = np.zeros(size, bool)
        for i, piece in enumerate(pieces):
            if sp.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.surface[i], self.is_byte[i] = bytes([int(piece[3:5], 16)]), True
            elif not (sp.is_control(i) or sp.is_unknown(i)):
                ids[piece] = i
                self.surface[i] = piece.replace(SPACE, " ").encode()
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in ids):
            raise ValueError("a piece crosses from one word to the next; words can't be encoded alone")
        order = {s: k for k, s in enumerate(sorted({sp.get_score(i) for i in ids.values()}, reverse=True))}
        # symbols: piece ids, then characters that occur inside pieces without being one, then any other character
        self.symbol = dict(ids)
        for c in {c for p in ids for c in p}:
            self.symbol.setdefault(c, size + len(self.symbol))
        self.size = size
        self.other = size + len(self.symbol) + 1
        pairs = {}
        for piece, i in ids.items():
            for k in range(1, len(piece)):
                left, right = self.symbol.get(piece[:k]), self.symbol.get(piece[k:])
                if left is not None and right is not None:
                    pairs[(left << 20) | right] = (order[sp.get_score(i)], i)
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_rank = np.array([pairs[k][0] for k in self.pair_keys.tolist()], np.int64)
        self.pair_into = np.array([pairs[k][1] for k in self.pair_keys.tolist()], np.int64)
        self.cache: dict[str, bytes] = {}
        self.kept = 0

    def _rank(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = (left << 20) | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        hit = self.pair_keys[at] == key
        return np.where(hit, self.pair_rank[at], NONE), self.pair_into[at]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of each word (spaces written as :data:`SPACE`) as little-endian 32-bit integers."""
        if not words:
            return []
        text = "".join(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        distinct, place = np.unique(points, return_inverse=True)
        known = np.array([self.symbol.get(chr(c), self.other) for c in distinct.tolist()], np.int64)
        flat, word = known[place], np.repeat(np.arange(len(words)), lengths)
        char = np.arange(len(flat))  # the first character of each symbol
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        rank, into = np.full(len(flat), NONE), np.zeros(len(flat), np.int64)  # of the pair that a symbol begins; kept from round to round
        if len(flat) > 1:
            rank[:-1], into[:-1] = self._rank(flat[:-1], flat[1:])
            rank[:-1][word[:-1] != word[1:]] = NONE
        while len(flat):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.minimum.reduceat(rank, starts)
            at_best = np.repeat(best, np.diff(np.r_[starts, len(flat)]))
            open_word = at_best < NONE
            if not open_word.all():
                done.append((word[~open_word], flat[~open_word], char[~open_word]))
                keep = np.flatnonzero(open_word)
                if not len(keep):
                    break
                flat, word, char, rank, into, at_best = flat[keep], word[keep], char[keep], rank[keep], into[keep], at_best[keep]
            hits = np.flatnonzero(rank == at_best)
            # leftmost first: in a run of neighbouring hits every second one falls to the merge before it
            if len(hits) > 1:
                new_run = np.r_[True, np.diff(hits) != 1]
                first = np.maximum.accumulate(np.where(new_run, np.arange(len(hits)), 0))
                hits = hits[(np.arange(len(hits)) - first) % 2 == 0]
            made = into[hits]
            # the neighbours as they are when the occurrence is merged: the left one may be a merge of this round
            left = hits - 1
            left_symbol = flat[np.maximum(left, 0)]
            joined = np.r_[False, (hits[1:] - hits[:-1]) == 2] if len(hits) > 1 else np.zeros(len(hits), bool)
            left_symbol = np.where(joined, np.r_[0, made[:-1]], left_symbol)
            left_rank, _ = self._rank(left_symbol, made)
            left_rank[(left < 0) | (word[np.maximum(left, 0)] != word[hits])] = NONE
            right = np.minimum(hits + 2, len(flat) - 1)
            right_rank, _ = self._rank(made, flat[right])
            right_rank[(hits + 2 >= len(flat)) | (word[right] != word[hits])] = NONE
            opens = np.minimum(left_rank, right_rank) <= rank[hits]
            if opens.any():
                run = np.cumsum(opens) - opens  # earlier openings, of all words
                head = np.r_[True, word[hits][1:] != word[hits][:-1]]
                base = np.maximum.accumulate(np.where(head, run, 0))
                allowed = run == base
                hits, made = hits[allowed], made[allowed]
            flat[hits] = made
            gone = np.ones(len(flat), bool)
            gone[hits + 1] = False
            flat, word, char, rank, into = flat[gone], word[gone], char[gone], rank[gone], into[gone]
            at = hits - np.arange(len(hits))  # the places of the merged symbols, whose pairs are new, as are those of the symbols before them
            at = np.concatenate([at[at > 0] - 1, at])
            follower = np.minimum(at + 1, len(flat) - 1)
            rank[at], into[at] = self._rank(flat[at], flat[follower])
            rank[at[(at + 1 >= len(flat)) | (word[follower] != word[at])]] = NONE
        word, flat, char = (np.concatenate([d[k] for d in done]) for k in range(3))
        order = np.argsort(char, kind="stable")  # by first character: words in order, symbols in order
        word, flat, char = word[order], flat[order], char[order]
        if (flat >= self.size).any():  # bytes of characters that are no piece
            other = flat >= self.size
            written = [chr(c).encode() for c in points[char[other]].tolist()]
            count = np.ones(len(flat), np.int64)
            count[other] = np.fromiter(map(len, written), np.int64, len(written))
            word, flat, other = np.repeat(word, count), np.repeat(flat, count), np.repeat(other, count)
            flat[other] = self.byte_ids[np.frombuffer(b"".join(written), np.uint8)]
        stops = np.searchsorted(word, np.arange(len(words) + 1)) * 4
        data = flat.astype("<u4").tobytes()
        return [data[a:b] for a, b in zip(stops[:-1].tolist(), stops[1:].tolist(), strict=True)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of whole texts, with the begin and end ids."""
        out: list[bytes] = []
        for part in blocks(texts, BLOCK_CHARS):
            out += self._encode_block(part)
        return out

    def _encode_block(self, texts: list[str | None]) -> list[bytes]:
        if self.kept > CACHE_CHARS:
            self.cache, self.kept = {}, 0
        cache, cut = self.cache, _WORD.findall
        split = [cut(" " + t.replace(SPACE, " ")) if t else [] for t in texts]
        new = list(dict.fromkeys(w for words in split for w in words if w not in cache))
        cache.update(zip(new, self.encode_words([w.replace(" ", SPACE) for w in new]), strict=True))
        begin, end, get = np.uint32(self.bos).tobytes(), np.uint32(self.eos).tobytes(), cache.__getitem__
        out = [begin + b"".join(map(get, words)) + end for words in split]
        for w in new:
            if len(w) > KEPT_CHARS:
                del cache[w]
            else:
                self.kept += len(w) + WORD_COST
        return out

    def decode(self, ids: bytes) -> str:
        """Text of ids. Bytes that aren't UTF-8 become U+FFFD each; the space put before the text goes."""
        surface = self.surface
        said = b"".join([surface[i] for i in np.frombuffer(ids, "<u4").tolist()])
        inner = np.frombuffer(ids, "<u4")
        inner = inner[(inner != self.bos) & (inner != self.eos)]
        if len(inner) and said[:1] == b" " and not self.is_byte[inner[0]]:
            said = said[1:]
        try:
            return said.decode()
        except UnicodeDecodeError:
            return said.decode(errors="replace")


_WORD = re.compile(r" *[^ \n]+|\n| +")


@lru_cache(maxsize=4)
def model(path: str) -> Bpe:
    return Bpe(path)


def encode_decode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """The rows of ``docs`` with ``token_ids`` (binary, 32-bit little-endian) and ``decoded``, in place of any columns of these names."""

    def both(batch):
        bpe = model(path)
        ids = bpe.encode(batch.column(text).to_pylist())
        return ids, [bpe.decode(i) for i in ids]

    added = {"token_ids": "binary", "decoded": "string"}
    return beside(docs, [c for c in docs.columns if c not in added], added, both)


def encode_digest(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row."""

    def digests(batch):
        bpe = model(path)
        ids = bpe.encode(batch.column("text").to_pylist())
        return [len(i) // 4 for i in ids], [hashlib.sha256(i).hexdigest() for i in ids], [hashlib.sha256(bpe.decode(i).encode()).hexdigest() for i in ids]

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return beside(rows, ["doc_id"], {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}, digests)
