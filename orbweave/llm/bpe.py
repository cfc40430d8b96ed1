"""Operator 3, BPE encoding and decoding through a distinct-word table.

Each task of the scan gathers its documents into blocks of about ``block_bytes`` of text. A block splits every
text once, numbers its distinct words from the most frequent on, and keeps the texts as word numbers. The distinct
words go, compressed, to the range of the word table that owns them; the owner encodes each distinct word once and
answers with the ids in the same order. The block joins the answers back by word position and the ids to their
pieces (the vocabulary, a bounded table) for the decoded form. A frequent word is one entry per block, never one
row per use; texts themselves are not shuffled.

Decoding joins the pieces of all ids by a space, as the library does for a file without a decoder.
Defined cases: null text is the empty text (no tokens); null ids and repeated rows are kept; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.llm import textio
from orbweave.storage import materialize

BLOCK_BYTES = 32 << 20
RANGE_BYTES = 8 << 20
MAX_RANGES = 4096
#: Distinct words an owner keeps encoded at a time, and words that the library gets as one text.
TABLE_WORDS = 600_000
JOINED_WORDS = 512
#: Words of whole documents that a block keeps in one row, about.
GROUP_WORDS = 1 << 20
#: Rows of a block: the sizes and word numbers of some documents (owner -1), or the words that one owner encodes and their numbers.
GATHERED = "block long, owner int, doc_ids array<string>, sizes binary, words binary, numbers binary"
CODED = "doc_id string, n_tokens long, ids_sha256 string, decoded_sha256 string"


def make_splitter(path: str):
    """Words of a text exactly as the tokenizer of the file sees them; special tokens come as words of their own."""
    made, find = textio.load(path), textio.WORD_PATTERN.findall
    special = textio.special_tokens(made)
    cut = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None

    def plain(text: str) -> list[str]:
        if textio.SAFE.fullmatch(text):
            return find(text.lower())
        seen = made.normalizer.normalize_str(text) if made.normalizer else text
        return [seen[a:b] for a, b in (span for _, span in made.pre_tokenizer.pre_tokenize_str(seen))]

    def split(text: str) -> list[str]:
        if not cut or "<|" not in text or not cut.search(text):
            return plain(text)
        return [w for i, part in enumerate(cut.split(text)) for w in ([part] if i % 2 else plain(part))]

    return split


@functools.lru_cache(maxsize=4)
def _word_ends(path: str) -> np.ndarray:
    """Which ids end a word, by the suffix that the vocabulary marks it with; none if it has no such suffix."""
    made = textio.load(path)
    suffix = getattr(made.model, "end_of_word_suffix", None)
    return np.array([bool(suffix) and p.endswith(suffix) for p in pieces(path)[0]], dtype=bool)


def encode_words(path: str, words: list[str]) -> list[bytes]:
    """Per word: its ids as little-endian 32-bit numbers.

    Words of safe letters alone split the same way next to a space, so they are encoded many to a text and the
    ids cut after each id that ends a word; where the cuts do not match the words, and for other words, one by one.
    """
    made, ends, out = textio.load(path), _word_ends(path), [b""] * len(words)
    plain = [k for k, w in enumerate(words) if w.isalpha() and textio.SAFE.fullmatch(w)]
    single = sorted(set(range(len(words))).difference(plain))
    groups = [plain[a : a + JOINED_WORDS] for a in range(0, len(plain), JOINED_WORDS)]
    for own, got in zip(groups, made.encode_batch_fast([" ".join([words[k] for k in g]) for g in groups], add_special_tokens=False), strict=True):
        ids = np.array(got.ids, dtype="<u4")
        cuts = 4 * (np.flatnonzero(ends[ids]) + 1)
        if len(cuts) != len(own) or cuts[-1] != 4 * len(ids):
            single += own
            continue
        data, at = ids.tobytes(), 0
        for k, end in zip(own, cuts.tolist(), strict=True):
            out[k], at = data[at:end], end
    for k, got in zip(single, made.encode_batch_fast([words[k] for k in single], add_special_tokens=False), strict=True):
        out[k] = np.array(got.ids, dtype="<u4").tobytes()
    return out


@functools.lru_cache(maxsize=4)
def pieces(path: str) -> tuple[list[str], list[str]]:
    """Piece of each id, the bounded table that decoding joins with, and the ids in decimal."""
    made = textio.load(path)
    top = max(made.get_vocab(with_added_tokens=True).values(), default=-1) + 1
    return [made.id_to_token(i) or "" for i in range(top)], [str(i) for i in range(top)]


def _zip(text: str) -> bytes:
    return zstandard.compress(text.encode("utf-8", "surrogatepass"), 9)


def _unzip(data: bytes) -> str:
    return zstandard.decompress(data).decode("utf-8", "surrogatepass")


def pack_numbers(numbers: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, byte by byte of all, compressed."""
    return zstandard.compress(np.ascontiguousarray(numbers, dtype="<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 5)


def unpack_numbers(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), dtype=np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


def pack_ids(coded: list[bytes]) -> bytes:
    """Ids of a list of words: how many words, how many ids each has, then the ids."""
    sizes = np.array([len(c) // 4 for c in coded], dtype="<u4")
    return pack_numbers(np.concatenate([np.array([len(sizes)], dtype="<u4"), sizes, np.frombuffer(b"".join(coded), dtype="<u4")]))


def unpack_ids(data: bytes) -> list[list[int]]:
    raw = unpack_numbers(data)
    n = int(raw[0])
    sizes, ids = raw[1 : n + 1], raw[n + 1 :].tolist()
    ends = np.cumsum(sizes, dtype=np.int64).tolist()
    return [ids[b - k : b] for b, k in zip(ends, sizes.tolist(), strict=True)]


def _gather(batches: Iterator[pd.DataFrame], path: str, ranges: int, block_bytes: int) -> Iterator[pd.DataFrame]:
    """The blocks of one task, numbered by the task's partition; what it makes is written before anyone reads it."""
    split, block = make_splitter(path), TaskContext.get().partitionId() << 32
    index: defaultdict[str, int] = defaultdict()
    index.default_factory = index.__len__
    ids: list[str | None] = []
    texts: list[np.ndarray] = []
    held = 0

    def flush() -> pd.DataFrame:
        words, whole = list(index), np.concatenate(texts)
        order = np.argsort(-np.bincount(whole, minlength=len(words)), kind="stable")
        rank = np.empty(len(words), dtype="<u4")
        rank[order] = np.arange(len(words), dtype="<u4")
        ranked, ends = rank[whole], np.cumsum([len(t) for t in texts])
        rows, start = [], 0
        while start < len(texts):
            at = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, at + GROUP_WORDS, side="right")))
            sizes = np.diff(ends[start:stop], prepend=at)
            rows.append((block, -1, ids[start:stop], pack_numbers(sizes), None, pack_numbers(ranked[at : ends[stop - 1]])))
            start = stop
        owned: dict[int, tuple[list[str], list[int]]] = {}
        for number, k in enumerate(order.tolist()):
            own, numbers = owned.setdefault(zlib.crc32(words[k].encode("utf-8", "surrogatepass")) % ranges, ([], []))
            own.append(words[k])
            numbers.append(number)
        for owner, (own, numbers) in owned.items():
            rows.append((block, owner, None, None, _zip("\n".join(own)), pack_numbers(np.diff(numbers, prepend=0))))
        index.clear()
        ids.clear()
        texts.clear()
        return pd.DataFrame(rows, columns=["block", "owner", "doc_ids", "sizes", "words", "numbers"])

    for b in batches:
        for doc_id, text in zip(b["doc_id"], b["text"], strict=True):
            words = split(text)
            ids.append(doc_id)
            texts.append(np.fromiter(map(index.__getitem__, words), dtype="<u4", count=len(words)))
            held += len(text)
            if held >= block_bytes:
                yield flush()
                block, held = block + 1, 0
    if texts:
        yield flush()


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row: ``doc_id, n_tokens, ids_sha256, decoded_sha256``."""
    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    ranges = min(MAX_RANGES, max(1, -(-total // RANGE_BYTES)))

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table: dict[str, bytes] = {}
        for b in batches:
            done = []
            for z in b.pop("words"):
                words = _unzip(z).split("\n")
                if len(table) > TABLE_WORDS:
                    table.clear()
                new = [w for w in words if w not in table]
                table.update(zip(new, encode_words(path, new), strict=True))
                done.append(pack_ids([table[w] for w in words]))
            yield b.assign(ids=done)

    def finish(key, gathered: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        piece, decimal = pieces(path)
        answered = dict(zip(answers["owner"], answers["ids"], strict=True))
        asked, texts = gathered[gathered["owner"] >= 0], gathered[gathered["owner"] < 0]
        numbers = [np.cumsum(unpack_numbers(z), dtype=np.int64) for z in asked["numbers"]]
        n = sum(map(len, numbers))
        sizes, ids_of, text_of = np.zeros(n, dtype=np.int64), [""] * n, [""] * n
        for owner, own in zip(asked["owner"], numbers, strict=True):
            for number, ids in zip(own.tolist(), unpack_ids(answered[owner]), strict=True):
                sizes[number], ids_of[number], text_of[number] = len(ids), " ".join([decimal[i] for i in ids]), " ".join([piece[i] for i in ids])
        silent, out = bool((sizes == 0).any()), []
        for doc_ids, lengths, z in zip(texts["doc_ids"], texts["sizes"], texts["numbers"], strict=True):
            whole, ends = unpack_numbers(z), np.cumsum(unpack_numbers(lengths), dtype=np.int64)
            for doc_id, own in zip(doc_ids, np.split(whole, ends[:-1]), strict=True):
                count = int(sizes[own].sum())
                own = (own[sizes[own] > 0] if silent else own).tolist()
                ids, decoded = " ".join(map(ids_of.__getitem__, own)), " ".join(map(text_of.__getitem__, own))
                out.append((doc_id, count, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest()))
        return pd.DataFrame(out, columns=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    gathered = materialize(rows.mapInPandas(lambda b: _gather(b, path, ranges, block_bytes), GATHERED), "word-numbers")
    asked = gathered.where("owner >= 0").select("block", "owner", "words")
    answered = asked.repartition("owner").sortWithinPartitions("owner", "block").mapInPandas(answer, "block long, owner int, ids binary")
    placed = gathered.select("block", "owner", "doc_ids", "sizes", "numbers")
    return placed.groupBy("block").cogroup(answered.groupBy("block")).applyInPandas(finish, CODED).withColumn("doc_id", F.col("doc_id").cast("long"))


def op3_bpe(spark, sf_dir: str) -> DataFrame:
    """Query: token count and digests of ids and decoded text of every document."""
    return encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"), textio.tokenizer_path("word_bpe_49k.json"))
