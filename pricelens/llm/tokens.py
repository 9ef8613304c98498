"""Token counts behind a digest cache, and the encoder that the packer shares.

A text is cut at places where the tokenizer cuts in any case, and the pieces' results are kept in a
bounded table, so that the library runs once for each distinct piece in a worker. A text that holds
anything unusual (special strings, characters outside plain Latin letters, odd spacing) goes to the
library whole, so results are the library's own either way.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from collections.abc import Callable

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import one_thread, prepare, scratch, slices, stored, table, utf8

LIMIT = 1024
#: Entries of one worker's table of pieces; it starts anew when it is full, which costs time and changes no result.
PIECES = 800_000
#: Characters that neither normalisation nor the split of either tokenizer treats in a special way.
PLAIN = re.compile("[\\n -~¡-¬®-ÿ]*")
#: What would join two pieces: white space beside the single spaces at which byte-level texts are cut.
JOINED = re.compile(r"\s[ ]|[ ]\s|\A\s|\s\Z")

#: Byte-level vocabularies write each byte as one character: itself where it is printable, else the next one from 256 on.
PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_LEVEL = {b: b if b in PRINTED else 256 + k for k, b in enumerate([*[b for b in range(256) if b not in PRINTED], *PRINTED])}

_loaded: dict[str, Pieces] = {}


def digest_of(path: str) -> str:
    """The tokenizer's version: its file's bytes and the library's version."""
    import tokenizers

    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + tokenizers.__version__.encode()).hexdigest()


class Pieces:
    """One worker's tokenizer with its table of pieces."""

    def __init__(self, path: str):
        one_thread()
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [a.content for a in self.tokenizer.get_added_tokens_decoder().values()]
        conf = json.loads(self.tokenizer.to_str())
        steps = (conf["pre_tokenizer"] or {}).get("pretokenizers", [conf["pre_tokenizer"]])
        own = [x["pattern"]["Regex"] for x in steps if x and x["type"] == "Split"]
        #: Splitting by matches drops white space; byte-level splitting keeps it, before words.
        self.spaceless = bool(own)
        self.split = regex.compile(own[0] if own else public_tokenizers.PATTERN)
        self.lower = "Lowercase" in json.dumps(conf["normalizer"])
        self.first: dict[str, bytes] = {}
        self.inner: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def piece(self, text: str) -> bytes:
        """A plain text's split, each part through the library's model."""
        ids = [token.id for part in self.split.findall(text.lower() if self.lower else text)
               for token in self.tokenizer.model.tokenize(part.encode().decode("latin-1").translate(BYTE_LEVEL))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def ids(self, text: str) -> bytes:
        """Its ids, little-endian unsigned 32-bit, as the library gives them without added tokens."""
        if len(text) < 2 or not PLAIN.fullmatch(text) or any(s in text for s in self.special) or not self.spaceless and JOINED.search(text):
            return self.whole(text)
        if len(self.inner) > PIECES:
            self.inner.clear()
        if len(self.first) > PIECES:
            self.first.clear()
        if self.spaceless:
            return self.known(text.split(), "")
        head, *rest = text.split(" ")  # a piece but the first has the space before it
        if head not in self.first:
            self.first[head] = self.piece(head)
        return self.first[head] + self.known(rest, " ")

    def known(self, parts: list[str], before: str) -> bytes:
        inner = self.inner
        got = list(map(inner.get, parts))
        if None in got:
            for k, ids in enumerate(got):
                if ids is None:
                    p = parts[k]
                    if p not in inner:
                        inner[p] = self.piece(before + p)
                    got[k] = inner[p]
        return b"".join(got)


def encode(path: str) -> Callable[[str], bytes]:
    """text -> ids, by the worker's own table."""
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path].ids


def counts(misses: DataFrame, path: str) -> DataFrame:
    """(digest, text) -> (digest, n_tokens)."""

    def run(batches):
        ids_of = encode(path)
        for batch in batches:
            for part in slices(batch, 256, batch.column(1)):
                texts = utf8(part.column(1))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(ids_of((b or b"").decode())) // 4 for b in texts], pa.int64())], ["digest", "n_tokens"])

    return misses.select("digest", "text").mapInArrow(run, "digest binary, n_tokens long")


CACHE = "digest binary, n_tokens long, tokenizer string"


def cached(docs: DataFrame, path: str, cache: str, keep: list[str], text: str = "text") -> DataFrame:
    """``row`` (struct of ``keep``), ``n_bytes`` and ``n_tokens`` of each row; the cache at ``cache`` grows by what it lacked.

    The key is the SHA-256 of the normalised content (null becomes empty; bytes stay, since the
    byte-level tokenizer tells all of them apart) with the tokenizer's version digest. A text is encoded
    once however many rows hold it: distinct texts are made first, by a map-side combined aggregate, so a text
    that a third of all rows share reaches the shuffle once a task; only these meet the stored digests. The counts
    come back to rows without texts, by an equi-join that the planner splits where a digest is hot. Two runs that append at once store
    a digest twice with the same count; reading takes one. The cache folder may be missing at first.
    """
    spark, version = docs.sparkSession, digest_of(path)
    prepare(spark)
    content = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.octet_length(content).cast("long").alias("n_bytes"),
                        F.unhex(F.sha2(content, 256)).alias("digest"), content.alias("text"))
    spark.createDataFrame([], CACHE).write.mode("append").parquet(cache)  # so that the folder is there

    def stored_counts():
        return spark.read.schema(CACHE).parquet(cache).where(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))

    misses = keyed.groupBy("digest").agg(F.first("text").alias("text")).join(stored_counts().select("digest"), "digest", "left_anti")
    counts(misses, path).withColumn("tokenizer", F.lit(version)).write.mode("append").parquet(cache)
    return keyed.drop("text").join(stored_counts(), "digest", "left").select("row", "n_bytes", "n_tokens")


def op5_token_counts(spark, sf_dir: str, cache: str | None = None) -> DataFrame:
    """Counts of every whole document. The query starts with an empty cache unless a path is given."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    out = cached(table(spark, sf_dir, "documents"), path, cache or scratch(spark, "token-counts"), ["doc_id"])
    return out.select(F.col("row.doc_id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
