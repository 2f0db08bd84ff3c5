"""Token ids in binary files (operator 3): independent zstandard frames and a trailing seek table.

A file is a sequence of zstandard frames, each with the little-endian 32-bit ids of whole documents, then a skippable
frame with the documents' ids and lengths (its last eight bytes are its size), then a skippable frame in the public seekable layout: for each frame its
compressed size, size and checksum (low 32 bits of XXH64 of the content), and a footer. A reader takes the end of the
file first and decompresses the frames it needs only.

Tasks write one file each under a name of their own; a table written by Spark names the files of the tasks that
succeeded, so retries and lost executors leave no doubled rows. Files lie in ascending order of document id.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path, staged
from .common import bound_batches, fingerprint, gather, keep, numbered_words, utf8

END_ID = 1
FRAME_BYTES = 1 << 20
# Bytes of words that a worker keeps with their ids, at 180 a word; a full cache is emptied but for the last batch's words.
CACHE_BYTES = 64 << 20
# Layout of the public seekable format.
SKIPPABLE, SEEK_FRAME, SEEK_MAGIC, CHECKSUMS = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80
# Words that are one piece, of lower-case letters that no normal form changes; what marks follow as a piece of their own.
PLAIN, LAST, MARKS = re.compile("[a-zß-öø-ÿ]+"), re.compile("[A-Za-z0-9ß-öø-ÿ]"), "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
# The model's characters for bytes: itself if printable, the others numbered from 256 on.
_OTHERS = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
BYTE_CHARS = {b: chr(256 + n) for n, b in enumerate(_OTHERS)}


class WordEncoder:
    """Ids of whole texts, word by word: the tokenizer's pieces never cross ASCII white space.

    Words of lower-case Latin letters are one piece, which normalising leaves as it is, so they go to the tokenizer's model at
    once. A run of ASCII marks at the end of a word is a piece of its own.
    """

    def __init__(self, path: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or public_tokenizers.path("word_bpe_49k.json"))
        self.known: dict[str, bytes] = {}
        self.held = 0

    def _encode(self, words: Iterable[str]) -> dict[str, bytes]:
        out, rest, tokenize, pack = {}, [], self.tokenizer.model.tokenize, struct.pack
        for word in words:
            if PLAIN.fullmatch(word):
                ids = [t.id for t in tokenize(word if word.isascii() else word.encode().decode("latin-1").translate(BYTE_CHARS))]
                out[word] = pack(f"<{len(ids)}I", *ids)
            else:
                rest.append(word)
        if rest:
            for word, found in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)):
                ids = found.ids
                out[word] = pack(f"<{len(ids)}I", *ids)
        return out

    def of(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words, as little-endian 32-bit numbers."""
        known = self.known
        new = [w for w in words if w not in known]
        if new:
            ends, wanted = {}, set()
            for word in new:
                stem = word.rstrip(MARKS)
                if len(stem) == len(word) or not LAST.match(stem[-1:]) or "<|" in word:
                    wanted.add(word)
                else:
                    ends[word] = stem, word[len(stem):]
                    wanted.update(ends[word])
            fresh = self._encode(w for w in wanted if w not in known)
            for word, (stem, marks) in ends.items():
                fresh[word] = (fresh.get(stem) or known[stem]) + (fresh.get(marks) or known[marks])
            size = 180 * len(fresh)
            if self.held + size > CACHE_BYTES:
                self.known = known = {w: known[w] for w in words if w in known}
                self.held = 180 * len(known)
            known.update(fresh)
            self.held += size
        return [known[w] for w in words]

    def __call__(self, texts: Iterable[bytes]) -> list[bytes]:
        # Upper and lower case are one to the tokenizer, but its special tokens are found before that.
        number, ends, words = numbered_words(list(texts), lower=True)
        ids, ends = gather(self.of(words), number, ends)
        return [ids[a:b].tobytes() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


def word_encoder(path: str | None) -> WordEncoder:
    """One encoder for all tasks of a worker, which so share its cache."""
    return keep(f"encoder {path}", lambda: WordEncoder(path))


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The store of a path (local, s3, hdfs...) and the path in it."""
    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem(), path
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


def _skippable(magic: int, content: bytes) -> bytes:
    return struct.pack("<II", magic, len(content)) + content


def write_file(path: str, documents: Iterable[tuple[str | None, bytes]], frame_bytes: int = FRAME_BYTES, level: int = 3) -> dict:
    """Write documents' ids (as bytes) in the given order; gives the file's row of the manifest."""
    store, place = file_system(path)
    compress = zstandard.ZstdCompressor(level=level).compress
    entries, names, sizes, frames, pending, held = [], [], [], [], [], 0
    with store.open_output_stream(place) as out:
        def flush():
            content = b"".join(pending)
            frame = compress(content)
            out.write(frame)
            entries.append(struct.pack("<III", len(frame), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))
            frames.append(len(pending))
            pending.clear()

        for name, ids in documents:
            names.append(name)
            sizes.append(len(ids) // 4)
            pending.append(ids)
            held += len(ids)
            if held >= frame_bytes:
                flush()
                held = 0
        if pending:
            flush()
        # Directory: document counts of the frames, token counts, and the ids: their lengths (-1 for null), then their bytes.
        words = [None if n is None else n.encode() for n in names]
        head = struct.pack("<QQ", len(frames), len(names))
        body = compress(np.asarray(frames, "<u4").tobytes() + np.asarray(sizes, "<u8").tobytes()
                        + np.asarray([-1 if w is None else len(w) for w in words], "<i8").tobytes() + b"".join(w or b"" for w in words))
        out.write(_skippable(SKIPPABLE, head + body + struct.pack("<Q", len(head) + len(body) + 8)))
        out.write(_skippable(SEEK_FRAME, b"".join(entries) + struct.pack("<IBI", len(entries), CHECKSUMS, SEEK_MAGIC)))
    return {"path": path, "n_docs": len(names), "n_tokens": sum(sizes), "n_frames": len(entries)}


class TokenFile:
    """Reader of one file: the directory is read at once, frames on request."""

    def __init__(self, path: str):
        store, place = file_system(path)
        self.source = store.open_input_file(place)
        end = self.source.size()
        n, flags, magic = struct.unpack("<IBI", self._bytes(end - 9, 9))
        if magic != SEEK_MAGIC or flags != CHECKSUMS:
            raise ValueError(f"no seek table: {path}")
        seek = end - 9 - 12 * n - 8
        table = self._bytes(seek + 8, 12 * n)
        self.entries = np.frombuffer(table, "<u4").reshape(n, 3).astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.entries[:, 0])])
        size, = struct.unpack("<Q", self._bytes(seek - 8, 8))
        content = self._bytes(seek - size, size - 8)
        n_frames, n_docs = struct.unpack("<QQ", content[:16])
        body = zstandard.ZstdDecompressor().decompress(content[16:])
        self.frame_docs = np.frombuffer(body[:4 * n_frames], "<u4").astype(np.int64)
        self.lengths = np.frombuffer(body[4 * n_frames:4 * n_frames + 8 * n_docs], "<u8").astype(np.int64)
        sizes = np.frombuffer(body[4 * n_frames + 8 * n_docs:4 * n_frames + 16 * n_docs], "<i8")
        words, ends = body[4 * n_frames + 16 * n_docs:], np.cumsum(np.maximum(sizes, 0))
        self.names = [None if n < 0 else words[end - n:end].decode() for n, end in zip(sizes.tolist(), ends.tolist())]
        self.before = np.concatenate([[0], np.cumsum(self.lengths)])

    def _bytes(self, at: int, size: int) -> bytes:
        self.source.seek(at)
        return self.source.read(size)

    def frame(self, k: int) -> bytes:
        content = zstandard.ZstdDecompressor().decompress(self._bytes(int(self.starts[k]), int(self.entries[k, 0])), int(self.entries[k, 1]) or 1)
        if len(content) != self.entries[k, 1] or xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != self.entries[k, 2]:
            raise ValueError(f"frame {k} is damaged")
        return content

    def documents(self, wanted: set | None = None) -> Iterator[tuple[str | None, int, bytes]]:
        """(document, ids before it in the file, its ids) of all or the wanted documents; other frames stay closed."""
        doc = 0
        for k, n in enumerate(self.frame_docs.tolist()):
            if wanted is None or not wanted.isdisjoint(self.names[doc:doc + n]):
                content, first = self.frame(k), int(self.before[doc])
                for i in range(doc, doc + n):
                    if wanted is None or self.names[i] in wanted:
                        a, b = int(self.before[i]) - first, int(self.before[i + 1]) - first
                        yield self.names[i], int(self.before[i]), content[4 * a:4 * b]
            doc += n

    def close(self):
        self.source.close()


MANIFEST = "file_no long, path string, n_docs long, n_tokens long, n_frames long"


def write_tokens(docs: DataFrame, folder: str, id_column: str = "doc_id", text_column: str = "text",
                 tokenizer: str | None = None) -> DataFrame:
    """Encode and write all documents in ascending order of id; gives the manifest, one row per file.

    Null texts are empty; every document gets END_ID at its end, so an empty one has one id. Null ids come first. Rows
    with the same id are ordered by the text's fingerprint, and repeated rows are written each. Columns other than the
    two are not read. An empty table gives files without documents or none.
    """
    end = np.asarray([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = word_encoder(tokenizer)

        def rows():
            for batch in batches:
                yield from zip(batch["name"], (ids + end for ids in encode(batch["text"])))

        number = TaskContext.get().partitionId()
        yield pd.DataFrame([{"file_no": number, **write_file(f"{folder}/part-{number:06d}-{uuid.uuid4().hex}.tok", rows())}])

    bound_batches(docs.sparkSession)
    store, place = file_system(folder)
    store.create_dir(place, recursive=True)
    ordered = (docs.select(F.col(id_column).alias("id"), F.col(id_column).cast("string").alias("name"), utf8(text_column).alias("text"),
                           fingerprint(text_column).alias("fp"))
               .repartitionByRange("id").sortWithinPartitions("id", "fp").select("name", "text"))
    return staged(ordered.mapInPandas(run, MANIFEST), "token-manifest")


def read_tokens(manifest: DataFrame, id_type: str = "bigint", with_ids: bool = False) -> DataFrame:
    """One row per document from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    schema = "doc_id string, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else "")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, before in zip(batch["path"], batch["before"]):
                file, rows = TokenFile(path), []
                for name, start, ids in file.documents():
                    rows.append((name, before + start, len(ids) // 4, zlib.crc32(ids), *([ids] if with_ids else [])))
                    if len(rows) == 5000:
                        yield pd.DataFrame(rows, columns=[x.split()[0] for x in schema.split(", ")])
                        rows = []
                file.close()
                if rows:
                    yield pd.DataFrame(rows, columns=[x.split()[0] for x in schema.split(", ")])

    # One row per file of many megabytes: the running sum over them is small.
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = manifest.where("n_docs > 0").select("path", "file_no", before.alias("before"))
    width = max(1, manifest.sparkSession.sparkContext.defaultParallelism)
    dealt = files.repartition(width, "file_no").select("path", "before")
    return dealt.mapInPandas(run, schema).withColumn("doc_id", F.col("doc_id").cast(id_type))


def fetch(manifest: DataFrame, wanted: list) -> DataFrame:
    """Ids of some documents; every task opens the directories of its files and the frames with wanted documents only."""
    names = {None if w is None else str(w) for w in wanted}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                file = TokenFile(path)
                rows = [(name, np.frombuffer(ids, "<u4").astype(np.int64).tolist()) for name, _, ids in file.documents(names)]
                file.close()
                if rows:
                    yield pd.DataFrame(rows, columns=["doc_id", "ids"])

    return manifest.where("n_docs > 0").select("path").mapInPandas(run, "doc_id string, ids array<long>")


def round_trip(docs: DataFrame, folder: str | None = None, id_column: str = "doc_id", text_column: str = "text",
               tokenizer: str | None = None) -> DataFrame:
    """Write all documents and read the files back; the folder is a new one in the shared folder unless given."""
    folder = folder or scratch_path(docs.sparkSession, "tokens")
    manifest = write_tokens(docs, folder, id_column, text_column, tokenizer)
    return read_tokens(manifest, docs.schema[id_column].dataType.simpleString())
