"""Tokenization over text columns, and the relational forms of vocabulary lookup, merging, padding and decoding."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..kernels.sentencepiece import SentencePiece
from ..plans.text import TextOptions
from ..session import prepare
from ..sources.tokenizers import Tokenizer


def _mapped(df: DataFrame, source: Column, out: str, ddl: str, kind: pa.DataType, shared, f) -> DataFrame:
    """The rows with f(shared, value of source) in out, in place of a column of that name; null stays null."""
    prepare(df.sparkSession)
    model = df.sparkSession.sparkContext.broadcast(shared)
    rest = [x for x in df.schema if x.name.lower() != out.lower()]
    fields = "".join(f"`{x.name}` {x.dataType.simpleString()}, " for x in rest)

    def run(batches):
        for b in batches:
            made = [None if v is None else f(model.value, v) for v in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(made, kind)], [*b.schema.names[:-1], out])

    taken = {x.name.lower() for x in rest}
    name = next(n for n in ("_" * i + "source" for i in range(len(taken) + 1)) if n not in taken)
    return df.select(*[F.col(f"`{x.name}`") for x in rest], source.alias(name)).mapInArrow(run, fields + f"`{out}` {ddl}")


def normalized(df: DataFrame, model: SentencePiece, text: str = "text", out: str = "normalized") -> DataFrame:
    """Every row with its text as a SentencePiece model normalises it."""
    return _mapped(df, F.col(text), out, "string", pa.string(), model, lambda m, v: m.normalize(v))


def truncated(ids, limit: int, front: list[int], back: list[int]) -> Column:
    """Ids cut to a limit that includes special ones before and after, which stay in any case."""
    room = max(limit - len(front) - len(back), 0)
    special = lambda x: F.array(*[F.lit(v).cast("long") for v in x]) if x else F.array().cast("array<bigint>")
    return F.concat(special(front), F.slice(ids, 1, room) if room else F.array().cast("array<bigint>"), special(back))


def padded(ids, length, pad: int) -> tuple[Column, Column]:
    """(ids, mask) at a length, which may be a column."""
    length = length if isinstance(length, Column) else F.lit(length)
    n = F.size(ids)
    more = F.greatest(length - n, F.lit(0))
    return (
        F.concat(ids, F.array_repeat(F.lit(pad).cast("long"), more)),
        F.concat(F.transform(ids, lambda v: F.lit(1).cast("long")), F.array_repeat(F.lit(0).cast("long"), more)),
    )


def pad_batch(df: DataFrame, options: TextOptions, pad: int, batch: list[str], ids: str = "ids") -> DataFrame:
    """attention_mask, and ids padded as the options say. Longest: the longest row of equal batch columns, an aggregate joined
    back. Without padding rows of a batch of different lengths raise."""
    pad = options.pad_id if options.pad_id is not None else pad
    if isinstance(options.padding, int):
        a, m = padded(F.col(ids), options.padding, pad)
        return df.withColumn("attention_mask", m).withColumn(ids, a)
    sizes = df.groupBy(*batch).agg(F.max(F.size(ids)).alias("_long"), F.min(F.size(ids)).alias("_short"))
    joined = df.join(sizes, batch) if batch else df.crossJoin(F.broadcast(sizes))
    if options.padding is None:
        joined = joined.filter(F.assert_true(F.col("_long") == F.col("_short"), F.lit("texts have different lengths; set padding")).isNull())
    a, m = padded(F.col(ids), F.col("_long"), pad)
    return joined.withColumn("attention_mask", m).withColumn(ids, a).drop("_long", "_short")


def pad_texts(df: DataFrame, pad: int, batch: list[str], ids: str = "ids", count: str = "ones") -> DataFrame:
    """As `pad_batch` to the longest, of ids written as text: the padding is one repeated text, not an array of ids and one of the mask,
    whose ones are the row's own count."""
    sizes = df.groupBy(*batch).agg(F.max(count).alias("_long"))
    return df.join(sizes, batch).withColumn(ids, F.concat(ids, F.repeat(F.lit(f" {pad}"), F.col("_long") - F.col(count)))).drop("_long")


class TextProcessor:
    """A tokenizer with its options."""

    def __init__(self, tokenizer: Tokenizer, options: TextOptions = TextOptions()):
        self.tokenizer, self.options = tokenizer, options

    def encode(self, df: DataFrame, text: str = "text", out: str = "ids") -> DataFrame:
        o = self.options
        source = F.lower(text) if o.lowercase else F.col(text)
        special, limit = o.add_special_tokens, o.limit
        return _mapped(df, source, out, "array<bigint>", pa.list_(pa.int64()), self.tokenizer, lambda t, v: t.encode_truncated(v, special, limit))

    def encode_batch(self, df: DataFrame, batch: list[str], text: str = "text") -> DataFrame:
        """ids and attention_mask; rows of equal batch columns are padded together."""
        return pad_batch(self.encode(df, text), self.options, self.tokenizer.pad_id() or 0, batch)

    def decode(self, df: DataFrame, ids: str = "ids", out: str = "text", skip_special: bool = True) -> DataFrame:
        return _mapped(df, F.col(ids), out, "string", pa.string(), self.tokenizer, lambda t, v: t.decode(v, skip_special))


def words(df: DataFrame, key: list[str], text: str = "text", most: int | None = None) -> DataFrame:
    """(key, pos, piece): words between single spaces, the first `most` of them."""
    parts = F.filter(F.split(F.col(text), " "), lambda w: w != "")
    return df.select(*key, F.posexplode(F.slice(parts, 1, most) if most else parts).alias("pos", "piece"))


def lookup(pieces: DataFrame, vocabulary: DataFrame, unk: int) -> DataFrame:
    """Each piece with its id, unk if there is none: a join on the piece."""
    return pieces.join(vocabulary.select("piece", "id"), "piece", "left").withColumn("id", F.coalesce("id", F.lit(unk).cast("long")))


def merge_unknown(ids: DataFrame, key: list[str], unk: int) -> DataFrame:
    """Runs of unknown ids cut to their first."""
    before = F.lag("id").over(Window.partitionBy(*key).orderBy("pos"))
    return ids.withColumn("_before", before).filter(~((F.col("id") == unk) & (F.col("_before") == unk)) | F.col("_before").isNull()).drop("_before")


def collected(ids: DataFrame, key: list[str]) -> DataFrame:
    return ids.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda v: v["id"]).alias("ids"))


def decode_ids(ids: DataFrame, vocabulary: DataFrame, key: list[str], separator: str = " ") -> DataFrame:
    """(key, text): pieces by id, in order; ids that are not in the vocabulary are left out."""
    found = ids.select(*key, "pos", "id").join(vocabulary.select("id", "piece"), "id")
    return found.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "piece"))), lambda v: v["piece"]), separator).alias("text"))
