"""Packing tokenised documents into sequences of at most `room` tokens.

Documents become token ids with an end mark; one that is longer than a sequence is cut at multiples of `room`. Pieces go
to pseudorandom groups of about `group` pieces or fewer, and every group packs on its own by first-fit decreasing. A tournament
tree over the bins' free room (each node: the largest below it) finds the first bin that fits in log time.

Null text counts as empty: a document of the end mark alone. Equal pieces and repeated rows are packed like any others, a
null doc_id stays null, and other columns are ignored. A very long text is a row per sequence, never one array. An empty
table gives no rows.
"""

from __future__ import annotations

import string
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks_of

ROOM = 2048
GROUP = 4096
END = 1
CHUNK = 1 << 24
TOGETHER = 64
# The last letter or digit before punctuation: one that nothing after it can turn into something else.
_CUT = "[A-Za-z0-9\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]$"
_UP_TO_TAIL = "^(?s:.*)[^!-/:-@\\[-`{-~]"


class Encoder:
    """Token ids of texts as little-endian 32-bit bytes. Each distinct word of a chunk is tokenised once, the rest is Arrow.

    Right for tokenizers that drop white space, lower the case, cut between a letter or digit and punctuation and mark the
    end of words in their tokens, such as word_bpe_49k.json: a word's ids are those of its core, in small letters, and of
    the punctuation at its end.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        marks = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.marks = sorted({m.split("|")[0] + "|" if "|" in m else m for m in marks})
        tokens = self.tokenizer.get_vocab(with_added_tokens=False)
        self.last = np.zeros(max(tokens.values()) + 1, bool)
        self.last[[i for t, i in tokens.items() if t.endswith("</w>")]] = True

    def encode(self, texts: pa.Array) -> pa.Array:
        """The ids of each text; none for null."""
        texts = texts.cast(pa.large_string()).fill_null("")
        words = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        distinct = words.flatten().dictionary_encode()
        trimmed = pc.ascii_rtrim(distinct.dictionary, string.punctuation)
        cut = pc.or_(pc.match_substring_regex(trimmed, _CUT), pc.equal(trimmed, ""))
        core = pc.if_else(cut, trimmed, distinct.dictionary)
        core = pc.if_else(pc.string_is_ascii(core), pc.ascii_lower(core), core).dictionary_encode()
        tail = pc.if_else(cut, pc.replace_substring_regex(distinct.dictionary, _UP_TO_TAIL, ""), "").dictionary_encode()
        parts = [self.ids_of(x.dictionary.to_pylist()).take(x.indices) for x in (core, tail)]
        nothing = pa.scalar(b"", pa.large_binary())
        ids = pc.binary_join_element_wise(*parts, nothing).take(distinct.indices)
        out = pc.binary_join(pa.LargeListArray.from_arrays(pc.cast(words.offsets, pa.int64()), ids), nothing)
        special = np.zeros(len(texts), bool)
        for mark in self.marks:  # special tokens may hold or touch anything
            special |= pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)
        if special.any():
            listed = out.to_pylist()
            for i in np.flatnonzero(special).tolist():
                listed[i] = np.array(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, "<u4").tobytes()
            out = pa.array(listed, pa.large_binary())
        return out

    def ids_of(self, words: list[str]) -> pa.Array:
        """The ids of each word. Words of one run of letters are tokenised many in a text, told apart by the tokens that end words."""
        blobs, lengths, at, rest = [], [], [], []
        plain = []
        for i, w in enumerate(words):
            (plain if _one_run(w) else rest).append(i)
        for a in range(0, len(plain), TOGETHER * 256):
            lists = [plain[i : i + TOGETHER] for i in range(a, min(len(plain), a + TOGETHER * 256), TOGETHER)]
            for own, e in zip(lists, self.tokenizer.encode_batch_fast([" ".join([words[i] for i in x]) for x in lists], add_special_tokens=False), strict=True):
                ids = np.array(e.ids, "<u4")
                ends = np.flatnonzero(self.last[ids]) + 1
                if len(ends) == len(own) and ends[-1] == len(ids):
                    blobs.append(ids.tobytes())
                    lengths.append(np.diff(ends, prepend=0))
                    at += own
                else:
                    rest += own
        for a in range(0, len(rest), 20_000):
            for i, e in zip(rest[a : a + 20_000], self.tokenizer.encode_batch_fast([words[i] for i in rest[a : a + 20_000]], add_special_tokens=False), strict=True):
                blobs.append(struct.pack(f"<{len(e.ids)}I", *e.ids))
                lengths.append([len(e.ids)])
                at.append(i)
        offsets = np.concatenate(([0], 4 * np.cumsum(np.concatenate(lengths or [[0]]).astype(np.int64))))
        made = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(b"".join(blobs))])
        place = np.empty(len(at), np.int64)
        place[at] = np.arange(len(at))
        return made.take(pa.array(place))


def _one_run(word: str) -> bool:
    """Whether a word is but letters, also when composed and in small letters: it then is one run for the tokenizer."""
    return word.isalpha() and (word.isascii() or unicodedata.normalize("NFC", word).lower().isalpha())


_loaded: dict[str, Encoder] = {}


def token_pieces(docs: DataFrame, tokenizer: str, room: int = ROOM, end: int = END, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens[, ids]): documents as pieces of at most `room` token ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if tokenizer not in _loaded:
            _loaded[tokenizer] = Encoder(tokenizer)
        known, mark = _loaded[tokenizer], np.array([end], "<u4").tobytes()
        for whole in batches:
            for batch in chunks_of(whole, 1, CHUNK):
                doc, start, length, crc, total, ids = [], [], [], [], [], []
                for d, own in zip(batch.column(0).to_pylist(), known.encode(batch.column(1)), strict=True):
                    made = own.as_py() + mark
                    for a in range(0, len(made), 4 * room):
                        piece = made[a : a + 4 * room]
                        doc.append(d)
                        start.append(a // 4)
                        length.append(len(piece) // 4)
                        crc.append(zlib.crc32(piece))
                        total.append(len(made) // 4)
                        ids.append(piece) if with_ids else None
                columns = [pa.array(x, pa.int64()) for x in (doc, start, length, crc, total)] + ([pa.array(ids, pa.binary())] if with_ids else [])
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"][: len(columns)])

    kinds = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + (", ids binary" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, kinds)


def first_fit_decreasing(lengths: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin of each length, and where in it it starts."""
    order = np.argsort(-lengths, kind="stable")
    leaves = 1 << max(0, (len(lengths) - 1).bit_length())
    tree = [room] * (2 * leaves)
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i in order.tolist():
        need, node = int(lengths[i]), 1
        while node < leaves:
            node *= 2
            if tree[node] < need:
                node += 1
        bins[i], offsets[i] = node - leaves, room - tree[node]
        tree[node] -= need
        while node > 1:
            node //= 2
            best = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == best:
                break
            tree[node] = best
    return bins, offsets


def packed(pieces: DataFrame, n_pieces: int, room: int = ROOM, group: int = GROUP, seed: int = 7) -> DataFrame:
    """The pieces with sequence_id and offset. n_pieces, which may be an estimate, sets how many groups there are."""
    groups = max(1, round(n_pieces / group))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
        bins, offsets = first_fit_decreasing(frame["length"].to_numpy(), room)
        frame["sequence_id"] = (frame.pop("group").to_numpy().astype(np.int64) << 32) + bins
        frame["offset"] = offsets
        return frame

    dealt = pieces.withColumn("group", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", F.lit(seed)), F.lit(groups)))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return dealt.groupBy("group").applyInPandas(run, kinds)


def pack(docs: DataFrame, tokenizer: str, room: int = ROOM, group: int = GROUP, with_ids: bool = True) -> DataFrame:
    """token_pieces() in their places; with ids, each row holds the tokens that go to offset .. offset + length of its sequence."""
    # Texts have about 4 bytes a token, and at least one: so a group of long texts holds at most 4 times as many pieces.
    sizes = docs.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    return packed(token_pieces(docs, tokenizer, room, with_ids=with_ids), sizes.n + (sizes.bytes or 0) // (4 * room), room, group)
