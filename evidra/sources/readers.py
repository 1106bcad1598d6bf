"""Sources and sinks: JSON lines, JSON files, CSV, annotations, label XML, HTML sections, snapshots."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from html.parser import HTMLParser

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_jsonl(spark: SparkSession, path: str, schema: str, missing_ok: bool = True) -> DataFrame:
    """One JSON object a line; blank lines and a byte order mark are skipped, a missing file is empty or an error."""
    try:
        lines = spark.read.text(path)
    except AnalysisException as e:
        if missing_ok and e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise
    clean = lines.select(F.regexp_replace("value", "^\\ufeff", "").alias("value")).where(F.trim("value") != "")
    return clean.select(F.from_json("value", schema).alias("r")).select("r.*")


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array, or one object, per file."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_csv(spark: SparkSession, path: str, casts: dict[str, str]) -> DataFrame:
    """CSV with a header, all columns as text but for those with a type; values that don't fit are null."""
    rows = spark.read.option("header", True).csv(path)
    return rows.withColumns({c: F.col(c).try_cast(t) for c, t in casts.items()})


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """file, id, type, start, end, text of the text-bound lines of standoff annotation files."""
    line = r"^(T\d+)\t(\S+) (\d+)(?: \d+;\d+)* (\d+)\t(.*)$"
    rows = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), "value").where(F.col("value").rlike(line))
    part = lambda n: F.regexp_extract("value", line, n)
    return rows.select("file", part(1).alias("id"), part(2).alias("type"), part(3).cast("int").alias("start"), part(4).cast("int").alias("end"), part(5).alias("text"))


#: Fixed values of the HTML reader.
SKIPPED = {"script", "style", "nav", "header", "footer", "aside"}
HEADINGS = {"h1", "h2", "h3"}
KEPT = HEADINGS | {"p", "li"}
LONGEST_HEADING = 180


class _Blocks(HTMLParser):
    """Texts of headings, paragraphs and list items outside of skipped elements."""

    def __init__(self):
        super().__init__()
        self.skip, self.tag, self.parts, self.blocks = 0, None, [], []

    def handle_starttag(self, tag, attrs):
        if tag in SKIPPED:
            self.skip += 1
        elif tag in KEPT and not self.skip:
            self.flush()
            self.tag = tag

    def handle_endtag(self, tag):
        if tag in SKIPPED:
            self.skip = max(0, self.skip - 1)
        elif tag == self.tag:
            self.flush()

    def handle_data(self, data):
        if self.tag and not self.skip:
            self.parts.append(data)

    def flush(self):
        text = " ".join(" ".join(self.parts).split())
        if self.tag and text:
            self.blocks.append((self.tag, text))
        self.tag, self.parts = None, []


def html_blocks(html: str | None) -> list[tuple[str, str]]:
    parser = _Blocks()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    return parser.blocks


def html_sections(pages: DataFrame, page: str = "page_id", html: str = "html") -> DataFrame:
    """page, section_no, section, n_blocks, text: a heading starts a section, which is called by it in capitals.

    Blocks in front of the first heading are section 0, called BODY. Pages without text have no rows.
    """

    @F.pandas_udf("array<struct<tag string, text string>>")
    def blocks(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: [{"tag": a, "text": b} for a, b in html_blocks(x)])

    heading = lambda b: b["tag"].isin(*HEADINGS) & (F.length(b["text"]) <= LONGEST_HEADING)

    def add(state: Column, b: Column) -> Column:
        fresh = F.struct(F.upper(b["text"]).alias("section"), F.array().cast("array<string>").alias("texts"))
        body = F.struct(F.lit("BODY").alias("section"), F.array(b["text"]).alias("texts"))
        last = F.element_at(state, -1)
        more = F.struct(last["section"].alias("section"), F.concat(last["texts"], F.array(b["text"])).alias("texts"))
        longer = F.concat(F.slice(state, F.lit(1), F.size(state) - 1), F.array(more))
        return F.when(heading(b), F.concat(state, F.array(fresh))).when(F.size(state) == 0, F.array(body)).otherwise(longer)

    none = F.array().cast("array<struct<section:string,texts:array<string>>>")
    rows = pages.select(page, blocks(F.col(html)).alias("b")).select(page, F.posexplode(F.aggregate("b", none, add)).alias("section_no", "s"))
    return rows.select(page, "section_no", F.col("s.section").alias("section"), F.size("s.texts").alias("n_blocks"), F.array_join("s.texts", "\n").alias("text"))


def label_sections(content: bytes) -> list[tuple[str, str]]:
    """(title path, text) of each section of a drug label in XML, parents in front of their parts."""
    out = []

    def name(e) -> str:
        return e.tag.rpartition("}")[2]

    def walk(e, path):
        for child in e:
            if name(child) == "section":
                title = next((" ".join("".join(t.itertext()).split()) for t in child if name(t) == "title"), "")
                here = path + [title] if title else path
                text = " ".join(" ".join("".join(t.itertext()).split()) for t in child if name(t) == "text")
                if text:
                    out.append((" / ".join(here) or "UNTITLED", text))
                walk(child, here)
            else:
                walk(child, path)

    walk(ET.fromstring(content), [])
    return out


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """file, section_no, section, text of drug labels in XML; files are parsed where they are read."""

    def parse(frames):
        for f in frames:
            rows = [(p, n, s, t) for p, c in zip(f["path"], f["content"]) for n, (s, t) in enumerate(label_sections(c))]
            yield pd.DataFrame(rows, columns=["file", "section_no", "section", "text"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(parse, "file string, section_no int, section string, text string")


def table_markdown(rows: Column) -> Column:
    """Rows of cells, array<array<string>>, as a Markdown table: filled up to the widest row, | escaped."""
    width = F.array_max(F.transform(rows, lambda r: F.size(r)))
    cell = lambda c: F.replace(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), "\\s+", " ")), F.lit("|"), F.lit("\\|"))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.concat(F.transform(r, cell), F.array_repeat(F.lit(""), width - F.size(r))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    lines = F.transform(rows, line)
    return F.when(F.coalesce(width, F.lit(0)) <= 0, "").otherwise(F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, F.lit(2), F.size(lines))), "\n"))


def promote(df: DataFrame, root: str, run_id: str, valid: Column | None = None) -> DataFrame:
    """Write df to root/runs/<run_id>, check it, make it current by one rename, and return a one-row manifest of what is current.

    root/current names the run, so readers see the old snapshot or the new one, never a half; see
    current(). `valid` has to hold for every row (null fails); if it doesn't, or the run has no rows where
    `valid` is given, an error is raised and the old snapshot stays current.
    """
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(f"{root}/runs/{run_id}")
    written = spark.read.parquet(f"{root}/runs/{run_id}")
    bad = F.count_if(~F.coalesce(valid, F.lit(False))) if valid is not None else F.lit(0)
    content = F.bit_xor(F.xxhash64(*written.columns)).alias("content")
    manifest = written.agg(F.lit(run_id).alias("run_id"), F.count(F.lit(1)).alias("n_rows"), content, bad.cast("long").alias("n_bad")).first()
    if valid is not None and (manifest["n_bad"] or not manifest["n_rows"]):
        raise ValueError(f"run {run_id} isn't promoted: {manifest['n_bad']} of {manifest['n_rows']} rows fail the check")
    files = spark.sparkContext._jvm.org.apache.hadoop.fs
    folder = files.Path(root)
    store = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    new, current_file = files.Path(folder, f"current.{run_id}"), files.Path(folder, "current")
    out = store.create(new, True)
    out.write(bytearray(run_id.encode()))
    out.close()
    context = files.FileContext.getFileContext(store.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    overwrite = spark.sparkContext._gateway.new_array(files.Options.Rename, 1)
    overwrite[0] = getattr(files.Options, "Rename").OVERWRITE
    context.rename(store.makeQualified(new), store.makeQualified(current_file), overwrite)
    return spark.createDataFrame([(manifest["run_id"], manifest["n_rows"], manifest["content"])], "run_id string, n_rows long, content long")


def current(spark: SparkSession, root: str) -> DataFrame:
    """The snapshot that was promoted last."""
    run_id = spark.read.text(f"{root}/current").first()[0]
    return spark.read.parquet(f"{root}/runs/{run_id}")
