"""BPE encoding and decoding by a pair occurrence index.

All distinct words of a chunk of texts are laid out in one array of symbols with links to the neighbours. An index maps
each mergeable pair to all its positions; the active ranks are taken in ascending order from a heap, all positions of
the pair merge at once, and the pairs that thereby arise left and right go to the lists of their ranks.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import cols, ddl, table, text_chunks, unused, with_text

#: Fixed value: the pattern by which byte-level BPE of this family cuts texts into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Distinct words that a worker keeps with their ids; beyond, it starts anew.
KEPT_WORDS = 200_000


def byte_letters() -> list[str]:
    """The letter that stands for each byte in vocabularies: itself if printable, else the next one from U+0100 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in printable else next(spare)) for b in range(256)]


class Codec:
    """A byte-level BPE vocabulary: encodes lists of words, decodes ids.

    Raises ValueError for vocabularies in which a merge may precede the one that makes its parts; there, merging all
    words by ascending rank could differ from merging them one by one."""

    def __init__(self, definition: str):
        spec = json.loads(definition)
        vocab = spec["model"]["vocab"]
        letters = byte_letters()
        value = {c: b for b, c in enumerate(letters)}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        made: dict[str, int] = {}
        for rank, (a, b) in enumerate(pairs):
            if any(len(x) > 1 and x not in made for x in (a, b)) or (a + b) in made:
                raise ValueError("the merges aren't in the order in which they arise")
            made[a + b] = rank
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.left, self.right = left, right
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        key = (left << 20) | right
        order = np.argsort(key)
        self.keys, self.ranks = key[order], order.astype(np.int32)
        self.byte_ids = np.array([vocab[c] for c in letters], np.int32)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        by_id = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.pieces = [b""] * (max(by_id) + 1)
        for i, t in by_id.items():
            known = all(c in value for c in t)
            self.pieces[i] = bytes(value[c] for c in t) if known else t.encode()
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.none = np.int32(len(pairs))
        self.first_ranks = self._lookup(np.repeat(self.byte_ids, 256), np.tile(self.byte_ids, 256))

    def _lookup(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a.astype(np.int64) << 20) | b
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.ranks[at], self.none)

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one after the other, and their number by word."""
        lens = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        n = len(raw)
        if not n:
            return np.zeros(0, np.int32), lens
        ends = np.cumsum(lens)
        sym = np.append(self.byte_ids[raw], np.int32(-1))  # at n: no symbol
        nxt = np.arange(1, n + 2, dtype=np.int32)
        prv = np.arange(-1, n, dtype=np.int32)
        nxt[ends[lens > 0] - 1] = n
        prv[(ends - lens)[lens > 0]] = n
        nxt[n] = prv[n] = n
        first = np.full(n, self.none, np.int32)
        first[:-1] = self.first_ranks[raw[:-1].astype(np.int64) * 256 + raw[1:]]
        first[nxt[:n] == n] = self.none
        lists: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def put(pos: np.ndarray, rank: np.ndarray) -> None:
            found = rank < self.none
            pos, rank = pos[found], rank[found]
            if not len(pos):
                return
            order = np.argsort(rank, kind="stable")
            pos, rank = pos[order], rank[order]
            cut = [0, *(np.flatnonzero(rank[1:] != rank[:-1]) + 1).tolist(), len(rank)]
            for at, low, high in zip(rank[cut[:-1]].tolist(), cut, cut[1:], strict=False):
                if at in lists:
                    lists[at].append(pos[low:high])
                else:
                    lists[at] = [pos[low:high]]
                    heapq.heappush(active, at)

        put(np.arange(n, dtype=np.int32), first)
        while active:
            rank = heapq.heappop(active)
            got = lists.pop(rank)
            pos = np.sort(np.concatenate(got)) if len(got) > 1 else got[0]
            a, b = self.left[rank], self.right[rank]
            pos = pos[(sym[pos] == a) & (sym[nxt[pos]] == b)]
            if len(got) > 1 and len(pos) > 1:
                pos = pos[np.append(True, pos[1:] != pos[:-1])]
            if not len(pos):
                continue
            if a == b and len(pos) > 1:  # of overlapping occurrences, each second one from the left
                here = np.arange(len(pos))
                fresh = np.append(True, nxt[pos[:-1]] != pos[1:])
                pos = pos[(here - np.maximum.accumulate(np.where(fresh, here, 0))) % 2 == 0]
            gone = nxt[pos]
            after = nxt[gone]
            sym[pos] = self.made[rank]
            sym[gone] = -2
            nxt[pos] = after
            prv[after] = pos
            prv[n] = n
            # of two neighbours that both merged, the later store of nxt must win
            before = prv[pos]
            sides = np.concatenate([before, pos])
            sides = sides[sides < n]
            put(sides, self._lookup(sym[sides], sym[nxt[sides]]))
        alive = sym[:n] >= 0
        total = np.append(0, np.cumsum(alive))
        return sym[:n][alive], total[ends] - total[ends - lens]

    def decode(self, ids: Iterable[int]) -> str:
        """The text of the ids; what isn't UTF-8 gives replacement characters."""
        return b"".join(map(self.pieces.__getitem__, ids)).decode("utf-8", "replace")


class _Words(dict):
    """Gives each new word the next number."""

    def __missing__(self, word: str) -> int:
        out = self[word] = len(self)
        return out


class Encoder:
    """Encodes chunks of texts, keeping the ids of words it has seen."""

    def __init__(self, codec: Codec):
        self.codec, self.find = codec, regex.compile(WORDS).findall
        self._reset()

    def _reset(self) -> None:
        self.words = _Words()
        self.flat = np.zeros(0, np.int32)
        self.at, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        if len(self.words) > KEPT_WORDS:
            self._reset()
        codec, number = self.codec, self.words.__getitem__
        rows, lens, fresh = [], [], len(self.words)
        special: dict[int, int] = {}
        for text in texts:
            if codec.split_special and any(s in text for s in codec.special):
                row: list[int] = []
                for k, part in enumerate(codec.split_special.split(text)):
                    if k % 2:
                        w = number("\0special\0" + part)  # can't be a word: words don't mix controls and letters
                        special[w] = codec.special[part]
                        row.append(w)
                    else:
                        row += map(number, self.find(part))
            else:
                row = list(map(number, self.find(text)))
            rows.append(np.array(row, np.int64))
            lens.append(len(row))
        new = list(self.words)[fresh:] if len(self.words) > fresh else []
        if new:
            ids, size = codec.encode_words([b"" if fresh + k in special else w.encode() for k, w in enumerate(new)])
            if special and any(k >= fresh for k in special):  # each is one id of its own
                at = np.cumsum(size) - size
                for k in sorted((k for k in special if k >= fresh), reverse=True):
                    ids = np.insert(ids, at[k - fresh], special[k])
                    size[k - fresh] = 1
            base = len(self.flat)
            self.flat = np.concatenate([self.flat, ids])
            self.at = np.concatenate([self.at, base + np.cumsum(size) - size])
            self.size = np.concatenate([self.size, size])
        w = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        size = self.size[w] if len(w) else np.zeros(0, np.int64)
        stops = np.cumsum(size)
        total = int(stops[-1]) if len(stops) else 0
        ids = self.flat[np.repeat(self.at[w] - (stops - size), size) + np.arange(total)] if total else np.zeros(0, np.int32)
        bound = np.append(0, stops)[np.cumsum(lens)] if lens else np.zeros(0, np.int64)
        return np.split(ids, bound[:-1]) if lens else []


def encode_texts(docs: DataFrame, definition: str, text_col: str = "text", with_ids: bool = True, with_decoded: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Encodes ``text_col`` of each row with the vocabulary ``definition`` (the JSON text of a byte-level BPE).

    Returns the columns ``keep`` and n_tokens long, ids_sha256 string and, as asked for, ids array<int>,
    decoded_sha256 string (of the text that decoding the ids gives). A null text is the empty text; repeated rows
    stay. The occurrence of a special token's string in a text becomes its id. Narrow: no shuffle."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(definition)  # a vocabulary: its size doesn't depend on the data
    picked = with_text(docs, keep, text_col)
    schema = ddl(docs, keep) + ", ".join(x for x in ("n_tokens long", "ids_sha256 string", "ids array<int>" if with_ids else "", "decoded_sha256 string" if with_decoded else "") if x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared.value)
        encoder = Encoder(codec)
        for chunk in text_chunks(batches):
            texts = ["" if t is None else t for t in chunk.column(chunk.num_columns - 1).to_pylist()]
            ids = encoder.encode(texts)
            out = [*chunk.columns[:-1], pa.array([len(x) for x in ids], pa.int64())]
            out.append(pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids], pa.string()))
            if with_ids:
                out.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, ids)]), pa.int32()), pa.array(np.concatenate(ids), pa.int32())))
            if with_decoded:
                out.append(pa.array([hashlib.sha256(codec.decode(x.tolist()).encode()).hexdigest() for x in ids], pa.string()))
            names = [*keep, "n_tokens", "ids_sha256", *["ids"] * with_ids, *["decoded_sha256"] * with_decoded]
            yield pa.RecordBatch.from_arrays(out, names=names)

    return picked.mapInArrow(run, schema)


def decode_ids(rows: DataFrame, definition: str, ids_col: str = "ids", keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns ``keep`` and text: what the ids of ``ids_col`` (array<int>) stand for. Null ids give null."""
    shared = rows.sparkSession.sparkContext.broadcast(definition)
    picked = rows.select(*cols(keep), rows[ids_col].cast("array<int>").alias(unused("__ids", *keep)))
    kinds = ddl(rows, keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared.value)
        for batch in batches:
            texts = [None if x is None else codec.decode(x) for x in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*keep, "text"])

    return picked.mapInArrow(run, f"{kinds}text string")


def vocabulary(name: str = "byte_bpe_50k.json", path: str | None = None) -> str:
    """The JSON text of a vocabulary: of the file ``path``, or else of the public tokenizer ``name``."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(name)
    with open(path, encoding="utf-8") as f:
        return f.read()


def op8_bpe_pair_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    out = encode_texts(table(spark, sf_dir, "documents"), vocabulary(), with_ids=False, with_decoded=True, keep=("doc_id",))
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
