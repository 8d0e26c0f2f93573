"""Token counts as rollups that are maintained by deltas.

Totals by source, language and tokenizer version are sums, so they need no second look at documents
that did not change: an insert adds a document's tokens, a delete takes them away, a revision does
both. Each batch of changes is summed up first and written as a folder of its own; the totals are the
sum over the folders that a batch has claimed. Committing a batch again changes nothing.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterator

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("source", "lang", "tokenizer")
SUMS = ("n_docs", "n_tokens", "n_chars")

#: Folder of public vocabularies, and the pattern that cuts a text before byte pairs are merged.
VOCABULARIES = "/opt/tokenizers"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_pair_counter(name: str, folder: str = VOCABULARIES):
    """A column function counting tokens under a byte-pair vocabulary file; null has no tokens.

    The file must be at the same path on every executor. It is read once per Python worker.
    """
    path = os.path.join(folder, f"{name}.tiktoken")

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        encode = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for texts in batches:
            yield pd.Series([len(encode(t)) if t else 0 for t in texts], dtype="int64")

    return count


def word_counter(text: Column) -> Column:
    """Runs of characters without ASCII white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")


def count_changes(changes: DataFrame, tokenizers: dict) -> DataFrame:
    """Signed sums of one batch of changes, per source, language and tokenizer version.

    ``changes`` has source, lang, ``old_text`` and ``new_text``: an insert has no old text, a delete
    no new one, a revision both. A flag says which are present, ``has_old`` and ``has_new``, since a
    document's text may itself be null. Null keys are groups of their own.
    """
    sign = {"old": -1, "new": 1}
    sides = F.array(*[F.when(F.col(f"has_{s}"), F.struct(F.lit(k).alias("sign"), F.col(f"{s}_text").alias("text"))) for s, k in sign.items()])
    rows = changes.select("source", "lang", F.explode(sides).alias("side")).where("side is not null")
    rows = rows.select("source", "lang", "side.sign", "side.text")
    counted = rows.select(
        "source", "lang", "sign", F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("chars"),
        *[counter(F.col("text")).alias(f"_n{i}") for i, counter in enumerate(tokenizers.values())],
    )
    per_version = F.array(*[F.struct(F.lit(name).alias("tokenizer"), F.col(f"_n{i}").alias("tokens")) for i, name in enumerate(tokenizers)])
    long = counted.select("source", "lang", "sign", "chars", F.explode(per_version).alias("v"))
    return long.groupBy("source", "lang", F.col("v.tokenizer").alias("tokenizer")).agg(
        F.sum("sign").alias("n_docs"),
        F.sum(F.col("sign") * F.col("v.tokens")).alias("n_tokens"),
        F.sum(F.col("sign") * F.col("chars")).alias("n_chars"),
    )


class TokenLedger:
    """Committed batches in a folder that all executors share.

    Every commit writes its sums to a folder of its own attempt first. Then it claims the batch: a small
    file that names the attempt is renamed to the batch's name, which fails if that name is taken, so of
    several writers of one batch exactly one succeeds. Totals read the attempts that a claim names, and
    no others: what a writer left that died, or lost the race, never counts. On a store whose renames are
    not exclusive, a batch needs a single writer at a time.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, *parts: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *parts]))

    def _files(self):
        return self._path().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _claimed(self, name: str) -> bool:
        return self._files().exists(self._path("claims", name))

    def commit(self, batch: str, sums: DataFrame) -> bool:
        """Add a batch; False when a batch of that id is there already."""
        name = hashlib.sha256(batch.encode()).hexdigest()
        if self._claimed(name):
            return False
        attempt = f"{name}-{os.urandom(8).hex()}"
        sums.select(F.lit(batch).alias("batch"), *KEYS, *SUMS).write.parquet(f"{self.folder}/attempts/attempt={attempt}")
        return self._claim(name, attempt)

    def _claim(self, name: str, attempt: str) -> bool:
        files, draft = self._files(), self._path("drafts", attempt)
        files.mkdirs(self._path("claims"))
        out = files.create(draft, False)
        out.write(bytearray(attempt.encode()))
        out.close()
        context = self.spark.sparkContext
        jvm = context._jvm
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        plain = context._gateway.new_array(rename, 1)
        plain[0] = rename.NONE
        target = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), context._jsc.hadoopConfiguration())
        try:
            target.rename(draft, self._path("claims", name), plain)
        except Py4JJavaError as refused:
            if "FileAlreadyExistsException" not in str(refused.java_exception):
                raise
            files.delete(draft, False)
            return False
        return True

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, n_docs, n_tokens, n_chars); groups with nothing left are gone."""
        columns = f"batch string, source string, lang string, tokenizer string, {', '.join(f'{c} bigint' for c in SUMS)}, attempt string"
        if not self._files().exists(self._path("claims")):
            rows = self.spark.createDataFrame([], columns)
        else:
            claims = self.spark.read.text(f"{self.folder}/claims").select(F.col("value").alias("attempt"))
            attempts = self.spark.read.schema(columns).parquet(f"{self.folder}/attempts")
            rows = attempts.join(claims, "attempt", "left_semi")
        return rows.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS]).where("n_docs <> 0 or n_tokens <> 0 or n_chars <> 0")


def without_echoes(text: Column) -> Column:
    """The text without lines that repeat the line right above."""
    lines = F.split(text, "\n", -1)
    kept = F.filter(lines, lambda x, i: (i == 0) | (x != F.get(lines, i - 1)))
    return F.array_join(kept, "\n")


def inserts(docs: DataFrame) -> DataFrame:
    return _changes(docs.select("source", "lang", F.lit(None).cast("string").alias("old"), F.col("text").alias("new")), False, True)


def deletes(docs: DataFrame) -> DataFrame:
    return _changes(docs.select("source", "lang", F.col("text").alias("old"), F.lit(None).cast("string").alias("new")), True, False)


def revisions(docs: DataFrame, new_text: Column) -> DataFrame:
    """Documents whose text changes; those that stay the same have no delta."""
    rows = docs.select("source", "lang", F.col("text").alias("old"), new_text.alias("new"))
    return _changes(rows.where(~F.col("old").eqNullSafe(F.col("new"))), True, True)


def _changes(rows: DataFrame, has_old: bool, has_new: bool) -> DataFrame:
    return rows.select(
        "source", "lang", F.col("old").alias("old_text"), F.col("new").alias("new_text"),
        F.lit(has_old).alias("has_old"), F.lit(has_new).alias("has_new"),
    )
