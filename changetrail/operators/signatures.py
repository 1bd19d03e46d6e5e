"""Signatures of a log's files, by which a text search passes over files that can't hold its text.

A signature has a bit for each hash of the runs of ``GRAM`` characters in the pages and posts of one file.
A search needs all runs of its needle, so a file without one of them holds no match. Wildcards cut
a needle into parts; parts shorter than ``GRAM`` characters say nothing.
"""

from __future__ import annotations

from collections import defaultdict
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from changetrail.operators.search import EventFilter

GRAM = 3
# Bits of one signature: 128 KiB for a file, which is meant to hold 100 MB or more.
BITS = 1 << 20
FILE = "file"


def literal_parts(where: EventFilter) -> list[str]:
    """The runs of characters that a match holds as they are; none if case is ignored."""
    if where.ignore_case:
        return []
    if where.literal:
        return [where.search]
    parts, chars, i = [], [], 0
    while i < len(where.search):
        char = where.search[i]
        if char in "%_":
            parts.append("".join(chars))
            chars = []
        else:
            # A backslash takes the next character as it is; one at the end takes the closing wildcard.
            if char == "\\":
                i += 1
                char = where.search[i] if i < len(where.search) else "%"
            chars.append(char)
        i += 1
    return [*parts, "".join(chars)]


def needle_grams(where: EventFilter) -> list[str]:
    """The runs of GRAM characters that every match holds."""
    return sorted({part[i:i + GRAM] for part in literal_parts(where) for i in range(len(part) - GRAM + 1)})


def grams(text: Column) -> Column:
    """The distinct runs of GRAM characters of a text."""
    starts = F.when(F.char_length(text) >= GRAM, F.sequence(F.lit(1), F.char_length(text) - GRAM + 1))
    return F.coalesce(F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(GRAM)))),
                      F.array().cast("array<string>"))


def place(gram: Column) -> Column:
    """The bit of a gram, from 1, as the bitmap functions count."""
    return F.pmod(F.xxhash64(gram), F.lit(BITS)) + 1


def file_signatures(log: DataFrame) -> DataFrame:
    """``file, bucket, bits, event_date, batch`` of every file of ``log``, read from files."""
    texts = log.select("event_date", "batch", F.col("_metadata.file_path").alias(FILE),
                       F.explode(F.array_distinct(F.concat(grams(F.col("page")), grams(F.col("post")))))
                       .alias("gram"))
    # A file has few grams, which come with most of its rows: each goes on once, not sorted by the bitmaps.
    places = texts.select(FILE, "event_date", "batch", place(F.col("gram")).alias("place")).distinct()
    return (places
            .groupBy(FILE, F.bitmap_bucket_number("place").alias("bucket"), "event_date", "batch")
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
            .select(FILE, "bucket", "bits", "event_date", "batch"))


def needed_bits(spark: SparkSession, needles: list[str]) -> dict[int, dict[int, int]]:
    """Per bucket the bits of the needles: a mask for each byte that has some."""
    row = spark.range(1).select(*[F.struct(
        F.bitmap_bucket_number(place(F.lit(gram))).alias("bucket"),
        F.bitmap_bit_position(place(F.lit(gram))).alias("bit")).alias(f"g{i}")
        for i, gram in enumerate(needles)]).first()
    masks: dict[int, dict[int, int]] = defaultdict(lambda: defaultdict(int))
    for bucket, bit in row:
        masks[bucket][bit // 8] |= 1 << bit % 8
    return masks


def files_with(signatures: DataFrame, needles: list[str]) -> DataFrame:
    """``file`` of the signatures that have the bits of all needles."""
    masks = needed_bits(signatures.sparkSession, needles)

    def holds(byte: int, mask: int) -> Column:
        value = F.conv(F.hex(F.substring("bits", byte + 1, 1)), 16, 10).cast("int")
        return value.bitwiseAND(mask) == mask

    in_bucket = reduce(lambda chain, item: chain.when(
        F.col("bucket") == item[0], reduce(and_, [holds(*byte) for byte in item[1].items()])), masks.items(), F)
    return (signatures.filter(F.col("bucket").isin(list(masks)))
            .groupBy(FILE).agg(F.count_if(in_bucket).alias("held"))
            .filter(F.col("held") == len(masks)).select(FILE))
