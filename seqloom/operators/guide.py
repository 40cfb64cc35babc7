"""Sample sheets: adding columns, seed lookup, duplicates, metadata in file names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.functions import seq as S

#: Patterns of the file names that carry metadata, of links that carry a consensus, and of
#: entries that stand for a failure.
WELL = "-([A-P]\\d{1,2})-"
PLATE = "([^-]*)-([^-]*)-([^-]*)-([^_YB]*)[YB]*(.)_"
LINK_KEY = "(?i)^(.*?_.*?)_.*(c4|c3b0)[^.]*\\.svg"
LINK_SEQUENCE = "(?i)_([^_]*)_m.{1,3}_c.{1,5}\\.svg"
FAILURE = "(?i)^(fail)|(AA)$"
BATCH = "(?:^|/)([A-Za-z0-9]*)_([ACGT]+\\d+N[ACGT]*)_(\\d+)"


def add_column(guide: DataFrame, values: DataFrame, column: str, *, key: str = "pos", default: str = "NA") -> DataFrame:
    """`guide` with the value of its key; missing and null ones are the default, 0 is kept.

    The last of several values of a key (by `line`, if there is one) counts.
    """
    order = F.max_by("value", "line") if "line" in values.columns else F.max("value")
    unique = values.groupBy(F.col(key).alias("_key")).agg(order.cast("string").alias(column))
    joined = guide.join(unique, guide[key] == unique._key, "left").drop("_key")
    return joined.withColumn(column, F.coalesce(F.col(column), F.lit(default)))


def best_seeds(seeds: DataFrame) -> DataFrame:
    """(tf, seed): by upper-cased name the first seed that is no dimer, else the last (order: line)."""
    mono = F.col("isdimer") != "dimer"
    chosen = F.coalesce(F.min_by(F.when(mono, F.col("seed")), F.when(mono, F.col("line"))), F.max_by("seed", "line"))
    return seeds.groupBy(F.upper("TF").alias("tf")).agg(chosen.alias("seed"))


def with_seed(guide: DataFrame, seeds: DataFrame, *, default: str = "AA") -> DataFrame:
    """`guide` with the standard seed of its TF, in any case of letters."""
    best = best_seeds(seeds).withColumnRenamed("tf", "_tf")
    return guide.join(best, F.upper("TF") == F.col("_tf"), "left").drop("_tf").withColumn("seed", F.coalesce("seed", F.lit(default)))


def not_methylated(guide: DataFrame, *, family: str = "family") -> DataFrame:
    """Without methylated samples and repeated header rows (GROUP)."""
    f = F.coalesce(F.col(family), F.lit(""))
    return guide.where(~F.contains(F.lower(f), F.lit("methylated")) & (f != "GROUP"))


def deduplicated(guide: DataFrame, *, key: str, order: list[Column]) -> DataFrame:
    """The first row of each key in the given order (make it total)."""
    return guide.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_r = 1").drop("_r")


def metadata(files: DataFrame, *, path: str = "path") -> DataFrame:
    """`files` with directory, stem, suffix, well, batch, barcode, cycle, and the parts of plate names
    (plate-TF-well-barcodeYBn_); what a name lacks is ''."""
    p = F.col(path)
    directory, stem, suffix = S.path_parts(p)
    return files.select("*", directory.alias("dir"), stem.alias("stem"), suffix.alias("suffix"), S.well(F.regexp_extract(p, WELL, 1)).alias("well"), *[F.regexp_extract(p, BATCH, k).alias(n) for k, n in enumerate(("batch", "barcode", "cyc"), 1)], *[F.regexp_extract(p, PLATE, k).alias(n) for k, n in enumerate(("plate", "tf", "plate_well", "plate_barcode", "plate_cyc"), 1)])


def renamed(matched: DataFrame, batch: str, cycle: str, *, by: str = "name") -> DataFrame:
    """Demultiplexed reads under the name batch_barcode_cycle."""
    return matched.withColumn(by, F.when(F.col(by).isNotNull(), F.concat_ws("_", F.lit(batch), F.col(by), F.lit(cycle))))


def paired_by_name(samples: DataFrame, backgrounds: DataFrame, pattern: str) -> DataFrame:
    """`samples` (name) with the first background, by `line`, whose name holds what `pattern`'s first
    group finds in theirs; samples without one have null.

    Names are searched for, so each pair is looked at; both sides are lists of files, and the
    distinct parts that are searched for are few.
    """
    keyed = samples.withColumn("_part", F.regexp_extract("name", pattern, 1))
    parts = keyed.where("_part <> ''").select("_part").distinct()
    hits = parts.join(backgrounds, F.contains(backgrounds["name"], F.col("_part"))).groupBy("_part").agg(F.min_by(backgrounds["name"], "line").alias("background"))
    return keyed.join(hits, "_part", "left").drop("_part")


def zipped(a: DataFrame, b: DataFrame, *, order: str = "line") -> DataFrame:
    """Two lists side by side by their places; an error if they differ in length. For lists of files
    or parameters: they are numbered in one task."""
    size = a.count()
    if size != b.count():
        raise ValueError("lists of different lengths")
    number = lambda df, tag: df.select(*[F.col(c).alias(f"{tag}_{c}") for c in df.columns if c != order], F.row_number().over(Window.orderBy(order)).alias("line"))
    return number(a, "a").join(number(b, "b"), "line")


def best_pwms(names: DataFrame, tfs: DataFrame, *, mono: bool = True, most: int = 20) -> DataFrame:
    """(TF, entry, line, step): matrices for a TF in order of preference: exact names among the
    monomeric ones, then its family's, then the same among all; `most` as in pwm_of().

    names: (line, entry, kind); the family is the TF's name without digits and letters behind it.
    An entry counts at each step that it satisfies, as the lists are searched one after another.
    """
    family = tfs.select("TF", F.regexp_extract("TF", "^([A-Za-z]+)", 1).alias("_family"))
    wanted = family.select("TF", F.explode(F.array(F.struct(F.col("TF").alias("look"), F.lit(0).alias("step")), F.struct(F.col("_family").alias("look"), F.lit(1).alias("step")))).alias("x")).select("TF", "x.look", "x.step")
    stem = lambda c: F.regexp_replace(F.upper(c), "[0-9L-]*$", "")
    hits = names.withColumn("_stem", stem("entry")).join(wanted.withColumn("_stem", stem("look")), "_stem").where(F.startswith(F.upper("entry"), F.upper("look")))
    every = hits.select("TF", "entry", "line", (F.col("step") + 2).alias("step"))
    found = hits.where(F.contains("kind", F.lit("mono"))).select("TF", "entry", "line", "step").unionByName(every) if mono else every
    by = Window.partitionBy("TF")
    ranked = found.withColumn("_r", F.row_number().over(by.orderBy("step", "line"))).withColumn("_n", F.count("*").over(by))
    return ranked.where((F.col("_r") < most) | (F.col("_r") == F.col("_n"))).drop("_r", "_n")


def links(pages: DataFrame, pattern: str, *, html: str = "html") -> DataFrame:
    """(link): each distinct first group of the pattern, case ignored, over all pages."""
    return pages.select(F.explode(F.regexp_extract_all(F.col(html), F.lit(f"(?i){pattern}"), F.lit(1))).alias("link")).distinct()


def unique_in_order(rows: DataFrame, value: str, *, by: str, order: str = "line") -> DataFrame:
    """(by, vals): each key's distinct values in the order of their first lines."""
    firsts = rows.groupBy(by, value).agg(F.min(order).alias("_o"))
    return firsts.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_o", F.col(value).alias("v")))), lambda x: x.v).alias("vals"))


def consensus_by_key(barcodes: DataFrame, links_: DataFrame, *, batch: str) -> DataFrame:
    """`barcodes` with the consensuses that link names carry: names of the batch, of cycle c4 or
    c3b0, keyed by their first two parts."""
    named = links_.where(F.contains("link", F.lit(f"_{batch}_")))
    key = F.regexp_extract("link", LINK_KEY, 1)
    sequence = F.regexp_extract("link", LINK_SEQUENCE, 1)
    found = named.select(key.alias("_key"), sequence.alias("s")).where("_key <> ''").groupBy("_key").agg(F.array_sort(F.collect_list("s")).alias("consensus"))
    keyed = barcodes.withColumn("_k", F.concat_ws("_", "barcode", F.lit(batch)))
    return keyed.join(found, keyed._k == found._key, "left").drop("_k", "_key").withColumn("consensus", F.coalesce("consensus", F.array().cast("array<string>")))


def filled(rows: DataFrame, sources: list[DataFrame], *, key: str = "protein", most: int = 5) -> DataFrame:
    """`rows` with consensus lists from sources in order of priority: (protein, line, consensus).

    A source's list is added while the row's own has at most `most` and the source's first entry
    is no failure (fail..., or ending in AA).
    """
    out = rows.withColumn("consensus", F.array().cast("array<string>"))
    for k, source in enumerate(sources):
        lists = source.groupBy(F.col(key).alias(f"_k{k}")).agg(F.transform(F.array_sort(F.collect_list(F.struct("line", "consensus"))), lambda x: x.consensus).alias(f"_s{k}"))
        more = F.col(f"_s{k}")
        fine = more.isNotNull() & (F.size("consensus") <= most) & ~F.element_at(more, 1).rlike(FAILURE)
        out = out.join(lists, out[key] == F.col(f"_k{k}"), "left").withColumn("consensus", F.when(fine, F.concat("consensus", more)).otherwise(F.col("consensus"))).drop(f"_k{k}", f"_s{k}")
    return out


def pwm_of(guide: DataFrame, names: DataFrame, *, most: int = 20) -> DataFrame:
    """(TF, entry, family): matrices whose name is the TF's with digits, L or - behind it, any case.

    Matrix names are split at that suffix, so it is an equi-join; of more than `most` the first
    most - 1 and the last stay, in the order of `line`.
    """
    stem = F.regexp_replace(F.upper("entry"), "[0-9L-]*$", "")
    want = guide.select("TF").distinct().withColumn("_stem", F.regexp_replace(F.upper("TF"), "[0-9L-]*$", ""))
    hits = names.withColumn("_stem", stem).join(want, "_stem").where(F.startswith(F.upper("entry"), F.upper("TF")))
    by = Window.partitionBy("TF")
    hits = hits.withColumn("_r", F.row_number().over(by.orderBy("line", "entry"))).withColumn("_n", F.count("*").over(by))
    return hits.where((F.col("_r") < most) | (F.col("_r") == F.col("_n"))).drop("_stem", "_r", "_n")
