"""Flat files of token ids without an index, and finding the documents in them.

A file is nothing but unsigned ids of 16 or 32 bits, low byte first; a document ends at each
end-of-document id.
Files are read in blocks that don't know of each other. In each block one vectorised search finds the
separators. A prefix scan over the blocks' few numbers then tells where the document that a block starts
in began, and how many documents came before.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siteops.llm import bpe
from siteops.llm.common import BLANK, fresh, others, scratch, slices, stored, table

END = 0
#: Bytes of a token, if a call does not say 4.
WIDTH = 2
#: Bytes of a block, and of a file after which a task starts another one.
BLOCK = 4 << 20
FILE = 256 << 20
#: Tokens that are written at once, beyond a single document.
SLICE = 1 << 18
IDS = (1 << 8 * WIDTH) - 1


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The store and the path in it, of a URI or a plain path."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path.removeprefix("file:")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def kind(width: int) -> str:
    """The numpy type of tokens of 2 or 4 bytes."""
    if width not in (2, 4):
        raise ValueError("a token has 2 or 4 bytes")
    return f"<u{width}"


def word_tokens(text: Column) -> Column:
    """An id from 1 to 65535 for each word of a text, by a hash of the word."""
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"[^{BLANK}]+"), F.lit(0))
    return F.transform(words, lambda w: (F.pmod(F.xxhash64(w), F.lit(IDS)) + 1).cast("int"))


def write(df: DataFrame, tokens: str, folder: str, end: int = END, width: int = WIDTH) -> DataFrame:
    """Writes the arrays `tokens` as flat files into `folder`; gives the other columns, `file` and `document`.

    `document` numbers the documents of a file from 0. Null is written like an empty array. A token
    equal to `end`, beyond `width` bytes or null is an error. Each attempt of a task writes files of its own names,
    and only those of the result count; the result is kept, so nothing is written twice.
    """
    kept = others(df, tokens, "file", "document")
    base = df.select(*(F.col(f"`{c}`") for c in kept))
    schema = base.withColumns({"file": F.lit(""), "document": F.lit(0).cast("long")}).schema
    form, most = kind(width), (1 << 8 * width) - 1

    def run(batches):
        store, root = located(folder)
        store.create_dir(root, recursive=True)
        out, name, size, number = None, "", 0, 0
        for batch in batches:
            arrays = batch.column(batch.num_columns - 1)
            if out is None or size >= FILE:
                if out is not None:
                    out.close()
                name = f"{folder}/{TaskContext.get().taskAttemptId()}-{uuid.uuid4().hex}.bin"
                out, size, number = store.open_output_stream(located(name)[1]), 0, 0
            for a, b in slices(np.diff(arrays.offsets.to_numpy()), SLICE):
                part = arrays.slice(a, b - a)
                flat = part.flatten()
                ids = flat.to_numpy(zero_copy_only=False)
                if flat.null_count or len(ids) and (ids.min() < 0 or ids.max() > most or (ids == end).any()):
                    raise ValueError(f"a token is null, the end-of-document id or has more than {8 * width} bits")
                ends = np.cumsum(np.diff(part.offsets.to_numpy()))
                data = np.insert(ids.astype(form), ends, end)
                out.write(data.tobytes())
                size += data.nbytes
            columns = [batch.column(i) for i in range(len(kept))]
            numbers = pa.array(np.arange(number, number + len(arrays)))
            number += len(arrays)
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array([name] * len(arrays), pa.string()), numbers], names=schema.names
            )
        if out is not None:
            out.close()

    array = F.coalesce(F.col(f"`{tokens}`"), F.array().cast("array<int>")).alias(fresh(df, "ids")[0])
    return stored(df.select(*(F.col(f"`{c}`") for c in kept), array).mapInArrow(run, schema))


def blocks(files: DataFrame, block: int = BLOCK, width: int = WIDTH) -> DataFrame:
    """(file, block, start, size) of every block of the files, from their sizes; sizes in bytes."""
    if block % width:
        raise ValueError(f"blocks hold whole tokens, {width} bytes each")

    def measure(batches):
        for batch in batches:
            names = batch.column(0).to_pylist()
            sizes = [located(n)[0].get_file_info(located(n)[1]).size for n in names]
            columns = [pa.array(names, pa.string()), pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["file", "size"])

    sized = files.select("file").distinct().mapInArrow(measure, "file string, size long").where("size > 0")
    starts = F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(block).cast("long"))
    each = sized.select("file", F.col("size").alias("all"), F.posexplode(starts).alias("block", "start"))
    return each.select("file", "block", "start", F.least(F.lit(block), F.col("all") - F.col("start")).alias("size"))


def scan(files: DataFrame, end: int = END, block: int = BLOCK, width: int = WIDTH) -> DataFrame:
    """(file, document, start, n_tokens, ended) of each document of the flat files in column `file`.

    `start` is the number of the document's first token in the file, `n_tokens` doesn't count the end.
    Tokens after the last end are a document that has not `ended`. Two ends in a row have an empty
    document between them. An empty file has no document. A file that ends inside a token is an error.
    """
    form = kind(width)

    def run(batches):
        for batch in batches:
            names, numbers, starts, sizes = (c.to_pylist() for c in batch.columns)
            for name, number, start, size in zip(names, numbers, starts, sizes):
                if size % width:
                    raise ValueError(f"{name} ends inside a token")
                store, path = located(name)
                with store.open_input_file(path) as file:
                    data = np.frombuffer(file.read_at(size, start), form)
                found = np.flatnonzero(data == end) + start // width
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([name]),
                        pa.array([number], pa.int32()),
                        pa.array([(start + size) // width], pa.int64()),
                        pa.array([found], pa.list_(pa.int64())),
                    ],
                    names=["file", "block", "stop", "ends"],
                )

    each = blocks(files, block, width)
    # One task for some blocks each, however few files there are.
    spread = each.repartition("file", "block")
    found = stored(spread.mapInArrow(run, "file string, block int, stop long, ends array<long>"))
    by_file = Window.partitionBy("file").orderBy("block")
    earlier = by_file.rowsBetween(Window.unboundedPreceding, -1)
    carried = found.select("file", "block", "stop", F.size("ends").alias("n"), F.array_max("ends").alias("last"))
    carried = carried.select(
        "file",
        "block",
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"),
        (F.coalesce(F.max("last").over(earlier), F.lit(-1)) + 1).alias("begin"),
        F.lead("block").over(by_file).isNull().alias("final"),
    )
    rows = found.join(carried, ["file", "block"])
    open_end = F.when(
        F.col("final") & (F.coalesce(F.array_max("ends") + 1, F.col("begin")) < F.col("stop")), F.array("stop")
    )
    stops = F.concat("ends", F.coalesce(open_end, F.array().cast("array<long>")))
    starts = F.concat(F.array("begin"), F.transform("ends", lambda e: e + 1))
    both = F.arrays_zip(F.slice(starts, 1, F.size(stops)).alias("start"), stops.alias("stop"))
    documents = F.transform(
        both,
        lambda d, i: F.struct(
            (F.col("before") + i).alias("document"),
            d["start"].alias("start"),
            (d["stop"] - d["start"]).alias("n_tokens"),
            (i < F.size("ends")).alias("ended"),
        ),
    )
    return rows.select("file", F.explode(documents).alias("d")).select("file", "d.*")


def op2_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of every document, counted in flat files that hold nothing but the tokens."""
    docs = table(spark, sf_dir, "documents").select("doc_id", word_tokens(F.col("text")).alias("tokens"))
    written = write(docs, "tokens", scratch(spark))
    found = scan(written.select("file"))
    return written.join(found, ["file", "document"]).select("doc_id", "n_tokens", "ended")


def op2_bpe_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for the tokens of the byte-level BPE; ids are stored one higher, as 0 ends a document."""
    import public_tokenizers

    tokenizer = bpe.Tokenizer(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = bpe.encode(docs, tokenizer, bpe.frequent_words(docs, tokenizer), out="tokens")
    tokens = F.transform("tokens", lambda i: i + 1).alias("tokens")
    written = write(encoded.select("doc_id", tokens), "tokens", scratch(spark))
    found = scan(written.select("file"))
    return written.join(found, ["file", "document"]).select("doc_id", "n_tokens", "ended")


SQL = r"""
SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens,
       true AS ended
FROM documents
"""
