"""Readers: expression matrices, series matrices, platform annotations, gene-set files, configuration. All give long, nullable
tables; text is read by Spark's own sources, so large files are split where their format allows."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from cohortloom.functions.encoders import first_symbol
from cohortloom.operators.relational import coalesce_join, overlay_join
from cohortloom.operators.scaling import log_if_raw
from cohortloom.session import try_number


@dataclass
class Cohort:
    """A study: long expression (gene, sample_id, value), clinical and endpoints by sample_id, and what is known of it."""

    name: str
    expr: DataFrame
    clinical: DataFrame
    endpoints: DataFrame
    meta: dict[str, str] = field(default_factory=dict)

    def aligned(self, least: int = 1) -> Cohort:
        """Only samples that all three tables have; fewer than ``least`` raise ValueError."""
        ids = self.expr.select("sample_id").distinct().join(self.clinical.select("sample_id"), "sample_id", "left_semi").join(self.endpoints.select("sample_id"), "sample_id", "left_semi")
        if (n := ids.count()) < least:
            raise ValueError(f"{self.name}: {n} samples in all three tables")
        keep = lambda d: d.join(ids, "sample_id", "left_semi")
        return Cohort(self.name, keep(self.expr), keep(self.clinical), keep(self.endpoints), {**self.meta, "n_samples": str(n)})

    def write(self, path: str) -> None:
        """Three Parquet folders and the metadata as JSON lines; no pickles."""
        for part in ("expr", "clinical", "endpoints"):
            getattr(self, part).write.mode("overwrite").parquet(f"{path}/{part}")
        spark = self.expr.sparkSession
        spark.createDataFrame([(self.name, self.meta)], "name string, meta map<string,string>").coalesce(1).write.mode("overwrite").json(f"{path}/meta")

    @staticmethod
    def read(spark: SparkSession, path: str) -> Cohort:
        m = spark.read.schema("name string, meta map<string,string>").json(f"{path}/meta").first()
        return Cohort(m["name"], *[spark.read.parquet(f"{path}/{p}") for p in ("expr", "clinical", "endpoints")], dict(m["meta"] or {}))


def header_of(spark: SparkSession, path: str, sep: str = "\t") -> list[str]:
    """The columns of a delimited file's first line."""
    line = spark.read.text(path).limit(1).collect()
    return [c.strip().strip('"') for c in line[0][0].split(sep)] if line else []


def read_matrix(spark: SparkSession, path: str, *, sep: str = "\t", keep_types: Sequence[str] = ("protein_coding",), log: bool = True, fill: float | None = 0.0, short_header: bool = False) -> DataFrame:
    """A gene x sample text matrix as long rows: symbols in upper case, repeated sample columns by their median, the first row
    of a repeated gene, texts and NaN to ``fill`` (None drops them), log2(x + 1) unless the values are in log space already.
    A column ``gene_type`` filters the rows. ``short_header``: the header lacks the first column's name. An empty file gives no rows."""
    head = header_of(spark, path, sep)
    names = ["gene", *head] if short_header else ["gene", *head[1:]]
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
    raw = spark.read.csv(path, sep=sep, schema=schema, header=True, enforceSchema=True).withColumn("__at", F.monotonically_increasing_id())
    kinds = [i for i, n in enumerate(names) if n.lower() == "gene_type"]
    if kinds:
        raw = raw.where(F.lower(F.col(f"c{kinds[0]}")).isin(*[k.lower() for k in keep_types]))
    cells = [i for i in range(1, len(names)) if i not in kinds]
    if not cells:
        return spark.createDataFrame([], "gene string, sample_id string, value double")
    raw = raw.withColumn("gene", F.upper(F.trim("c0"))).where("gene is not null and gene not in ('', 'NAN')")
    first = raw.groupBy("gene").agg(F.min("__at").alias("__at"))
    raw = raw.join(first, ["gene", "__at"], "left_semi")
    long = raw.select("gene", F.explode(F.array(*[F.struct(F.lit(names[i].replace(".", "-")).alias("sample_id"), F.col(f"c{i}").alias("text")) for i in cells])).alias("x")).select("gene", "x.*")
    value = try_number("text")
    long = long.select("gene", "sample_id", (F.coalesce(value, F.lit(fill)) if fill is not None else value).alias("v")).where("v is not null and abs(v) <> double('infinity')")
    if log:
        long = log_if_raw(long, "v", "v")
    return long.groupBy("gene", "sample_id").agg(F.median("v").alias("value"))


def read_gmt(spark: SparkSession, path: str) -> DataFrame:
    """Gene sets: name, description, genes (upper case); lines of fewer than three fields are skipped."""
    p = F.split("value", "\t")
    return spark.read.text(path).where(F.size(p) >= 3).select(F.trim(p[0]).alias("name"), F.trim(p[1]).alias("description"), F.filter(F.transform(F.slice(p, F.lit(3), F.greatest(F.size(p) - 2, F.lit(0))), lambda g: F.upper(F.trim(g))), lambda g: g != "").alias("genes"))


def read_annotation(spark: SparkSession, path: str) -> DataFrame:
    """Platform annotation: probe, gene (null where it names none). Comment lines (#, !, ^) are skipped; the header line starts with ID."""
    lines = spark.read.option("encoding", "ISO-8859-1").text(path).where(~F.substring("value", 1, 1).isin("#", "!", "^"))
    head = lines.where("value like 'ID\\t%'").limit(1).collect()
    if not head:
        raise ValueError(f"{path}: no header line that starts with ID")
    cols = [c.strip().lower() for c in head[0][0].split("\t")]
    at = cols.index("gene symbol") if "gene symbol" in cols else cols.index("symbol")
    p = F.split("value", "\t")
    d = lines.where("value not like 'ID\\t%'").select(F.trim(p[0]).alias("probe"), F.get(p, F.lit(at)).alias("s")).where("probe <> ''")
    return d.select("probe", first_symbol("s").alias("gene"))


def read_series(spark: SparkSession, path: str) -> dict[str, DataFrame | list[str] | str | None]:
    """A series matrix (text or gz): ``title``, ``platform_id``, ``sample_ids``, ``characteristics`` (sample_id, key, value: each cell keyed by
    itself, repeated keys with other values as key__2, key__3), ``expr`` (probe, sample_id, value; only listed samples).

    The header is a few lines per study and read on the driver's side; the table block stays distributed."""
    lines = spark.read.option("encoding", "ISO-8859-1").text(path)
    head = {}
    rows = [r[0].split("\t") for r in lines.where("value like '!Series_title%' or value like '!Series_platform_id%' or value like '!Sample_geo_accession%' or value like '!Sample_characteristics_ch1%'").collect()]
    for r in rows:
        head.setdefault(r[0], []).append([c.strip().strip('"') for c in r[1:]])
    ids = head.get("!Sample_geo_accession", [[]])[0]
    cells: dict[tuple[str, str], str] = {}
    for row in head.get("!Sample_characteristics_ch1", []):
        for s, c in zip(ids, row, strict=False):
            if ":" not in c:
                continue
            key, value = (x.strip() for x in c.split(":", 1))
            n, name = 1, key
            while (s, name) in cells and cells[s, name] != value:
                n += 1
                name = f"{key}__{n}"
            cells[s, name] = value
    chars = spark.createDataFrame([(s, k, v) for (s, k), v in cells.items()], "sample_id string, key string, value string")
    p = F.split("value", "\t")
    header = [r[0] for r in lines.where(F.regexp_like("value", F.lit('^"?ID_REF"?\t'))).limit(1).collect()]
    cols = [c.strip().strip('"') for c in header[0].split("\t")[1:]] if header else []
    body = lines.where(~F.substring("value", 1, 1).isin("!", "#", "^") & (F.trim("value") != "") & ~F.regexp_like("value", F.lit('^"?ID_REF"?\t')))
    keep = F.array(*[F.struct(F.lit(c).alias("sample_id"), F.get(p, F.lit(i + 1)).alias("text")) for i, c in enumerate(cols) if c in set(ids)]) if cols and ids else None
    if keep is None:
        expr = spark.createDataFrame([], "probe string, sample_id string, value double")
    else:
        expr = body.select(F.trim(F.translate(p[0], '"', "")).alias("probe"), F.explode(keep).alias("x")).select("probe", "x.sample_id", try_number("x.text").alias("value"))
    one = lambda k: (head.get(k, [[None]])[0] or [None])[0]
    return {"title": one("!Series_title"), "platform_id": one("!Series_platform_id"), "sample_ids": ids, "characteristics": chars, "expr": expr}


def read_row_keyed(spark: SparkSession, path: str) -> DataFrame:
    """The variant reading of characteristics: each row's key is that of its first cell, of a repeated key the first row counts,
    and cells without ``: `` are null. sample_id, key, value."""
    lines = spark.read.option("encoding", "ISO-8859-1").text(path)
    rows = [[c.strip().strip('"') for c in r[0].split("\t")] for r in lines.where("value like '!Sample_geo_accession%' or value like '!Sample_characteristics_ch1%'").collect()]
    ids = next((r[1:] for r in rows if r[0] == "!Sample_geo_accession"), [])
    out: dict[str, list[str | None]] = {}
    for r in rows:
        if r[0] == "!Sample_characteristics_ch1" and len(r) > 1 and ": " in r[1]:
            out.setdefault(r[1].split(": ", 1)[0], [c.split(": ", 1)[1] if ": " in c else None for c in r[1:]])
    return spark.createDataFrame([(s, k, v) for k, vs in out.items() for s, v in zip(ids, vs, strict=False)], "sample_id string, key string, value string")


def overlay_clinical(base: DataFrame, enrichment: DataFrame | None, survival: DataFrame | None, survival_columns: Sequence[str] = ("time_os", "event_os", "time_dfs", "event_dfs"), key: str = "sample_id") -> DataFrame:
    """Clinical table with gaps filled from an enrichment table (the base wins) and survival columns overlaid (the overlay wins)."""
    out = base if enrichment is None else coalesce_join(base, enrichment, [key])
    return out if survival is None else overlay_join(out, survival, key, survival_columns)


def first_of_file(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The first row of each key in the order of the file."""
    d = df.withColumn("__at", F.monotonically_increasing_id())
    return d.withColumn("__k", F.row_number().over(W.partitionBy(*keys).orderBy("__at"))).where("__k = 1").drop("__at", "__k")


def read_config(path: str) -> dict:
    """A configuration file: JSON, or YAML where PyYAML is installed."""
    text = Path(path).read_text()
    if path.endswith(".json"):
        return json.loads(text)
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("PyYAML is needed for YAML files") from e
    return yaml.safe_load(text)
