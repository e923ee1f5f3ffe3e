"""Files of an organisation as tables, and tables of a crawl by nth."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce
from urllib.error import HTTPError
from urllib.request import Request, urlopen

import pandas as pd
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewatch.functions.html import attribute, markup, unescaped
from pagewatch.functions.urls import request_url

RULE = "kind string, host_suffix string, path_prefix string, pattern string"


def settings(lines: DataFrame, cores: int = 8) -> DataFrame:
    """Key, value, number, problem of KEY=VALUE lines (value: text).

    # starts a comment. a*b*c is a product; a negative MAX_process is cores less that, at least 1; True and
    False are kept. Other values are a problem.
    """
    bare = lines.select(F.trim(F.split_part("value", F.lit("#"), F.lit(1))).alias("line")).where(F.contains("line", F.lit("=")))
    rows = bare.select(F.trim(F.split_part("line", F.lit("="), F.lit(1))).alias("key"), F.trim(F.split_part("line", F.lit("="), F.lit(2))).alias("value"))
    factors = F.split("value", "[*]")
    product = F.when(F.forall(factors, lambda x: F.trim(x).rlike("^-?[0-9]+$")), F.aggregate(factors, F.lit(1).cast("long"), lambda a, x: a * F.trim(x).cast("long")))
    number = F.when((F.col("key") == "MAX_process") & (product < 0), F.greatest(F.lit(cores) + product, F.lit(1))).otherwise(product)
    flag = F.lower("value").isin("true", "false")
    return rows.select("key", "value", number.alias("number"), (number.isNull() & ~flag).alias("problem"))


#: Of a rule file's name: the kinds of its rules.
PAIRS = {"WHITE": "WHITE", "LINK": "LINK", "REQUEST": "REQUEST"}
LISTS = {"BLACK": "BLACK", "ONLY": "ONLY"}


def rule_rows(texts: DataFrame) -> DataFrame:
    """RULE rows of rule files (name, body: JSON).

    BLACK and ONLY are lists of patterns; DOMAIN has lists allow and deny of host suffixes, and IPAddress a list allow of
    address prefixes; REDIRECT has maps allow and deny of host to path prefixes; WHITE, LINK and REQUEST are such a map.
    A body that isn't JSON, or of another shape, gives no rows; so do a file of another name, and what isn't text in a list.
    """
    none = F.lit(None).cast("string")
    text = lambda v: F.when(F.schema_of_variant(v) == "STRING", F.variant_get(v, "$", "string"))

    def part(name: str, schema: str, path: str = "j") -> DataFrame:
        whole = texts.where(F.col("name") == name).select(F.from_json("body", schema).alias("j")).where(f"{path} is not null")
        if "map" in schema:
            return whole.select(F.explode(path).alias("host", "paths")).select("host", F.filter(F.transform("paths", text), lambda v: v.isNotNull()).alias("paths"))
        return whole.select(F.explode(path).alias("v")).select(text(F.col("v")).alias("value")).where("value is not null")

    def rows(found: DataFrame, kind: str, host=none, path=none, pattern=none) -> DataFrame:
        return found.select(F.lit(kind).alias("kind"), host.alias("host_suffix"), path.alias("path_prefix"), pattern.alias("pattern"))

    def pairs(found: DataFrame, kind: str) -> DataFrame:
        return rows(found.select("host", F.explode("paths").alias("path")), kind, F.col("host"), F.col("path"))

    out = [rows(part(name, "array<variant>"), kind, pattern=F.col("value")) for name, kind in LISTS.items()]
    out += [pairs(part(name, "map<string,array<variant>>"), kind) for name, kind in PAIRS.items()]
    out += [rows(part("DOMAIN", "allow array<variant>, deny array<variant>", f"j.{k}"), k.upper(), F.col("value")) for k in ("allow", "deny")]
    out.append(rows(part("IPAddress", "allow array<variant>", "j.allow"), "IP", pattern=F.col("value")))
    schema = "allow map<string,array<variant>>, deny map<string,array<variant>>"
    out += [pairs(part("REDIRECT", schema, f"j.{k}"), "REDIRECT" if k == "allow" else "REDIRECT_DENY") for k in ("allow", "deny")]
    return reduce(DataFrame.unionByName, out)


def rule_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """RULE rows of files named after their kind, as WHITE.json."""
    name = F.regexp_extract(F.input_file_name(), r"([^/.]*)[^/]*$", 1)
    return rule_rows(spark.read.text(paths, wholetext=True).select(name.alias("name"), F.col("value").alias("body")))


def start_list(spark: SparkSession, path: str) -> DataFrame:
    """Url, src of the seeds."""
    return spark.read.text(path).select(F.trim("value").alias("url")).where("url <> ''").withColumn("src", F.lit("START"))


def mime_types(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Templates that are given, of CSV files with a header."""
    return spark.read.csv(paths, header=True).where("Template <> ''").select(F.col("Template").alias("mime")).distinct()


def write_nth(df: DataFrame, warehouse: str, name: str, nth: int) -> None:
    """The table's part of one crawl; writing it again replaces it, history stays."""
    df.drop("nth").write.mode("overwrite").parquet(f"{warehouse}/{name}/nth={nth}")


def read_before(spark: SparkSession, warehouse: str, name: str, nth: int, schema: str) -> DataFrame:
    """All parts of earlier crawls."""
    return spark.read.schema(schema).option("basePath", f"{warehouse}/{name}").parquet(f"{warehouse}/{name}").where(F.col("nth") < nth)


def newest_first(paths: Iterable[str]) -> list[str]:
    """Paths by the number that they end in, the largest first; those without a number last, by name."""
    number = lambda p: int(m[1]) if (m := re.search(r"([0-9]+)/*$", p)) else -1
    return sorted(sorted(paths), key=number, reverse=True)


def latest_good(spark: SparkSession, paths: Iterable[str]) -> DataFrame | None:
    """The first of paths, newest first, that can be read whole; None if none can."""
    for path in newest_first(paths):
        try:
            df = spark.read.parquet(path)
            df.agg(F.count("*"), *(F.count(c) for c in df.columns)).first()
            return df
        except PySparkException:
            continue
    return None


def write_csv(df: DataFrame, path: str) -> None:
    """Quoted, with a header."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def source_texts(spark: SparkSession, path: str) -> DataFrame:
    """Path, text, label (the folder's name) of whole files."""
    rows = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    name = F.input_file_name()
    return rows.select(name.alias("path"), F.col("value").alias("text"), F.element_at(F.split(name, "/"), -2).alias("label"))


def browser_record(pages: DataFrame, html: Column) -> DataFrame:
    """page_id, pos, kind (Request, Script, Download, History), field, no, value: the elements that a browser adds to a page.

    They are p elements with such a class; an id is FIELD_NO. A Script's value loses scheme, query and what wraps it.
    """
    whole = r"(?is)(<p(?=[\s/])(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?</p\s*>)"
    each = pages.select("page_id", F.posexplode(F.regexp_extract_all(markup(html), F.lit(whole), F.lit(1))).alias("pos", "element"))
    tag = F.regexp_extract("element", r"(?is)^(<p(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>)", 1)
    text = unescaped(F.regexp_replace(F.regexp_replace("element", r"(?is)^<p(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>", ""), r"(?is)</p\s*>$", ""))
    rows = each.select("page_id", "pos", F.initcap(attribute(tag, "class")).alias("kind"), F.coalesce(attribute(tag, "id"), F.lit("")).alias("id"), text.alias("text"))
    rows = rows.where(F.col("kind").isin("Request", "Script", "Download", "History"))
    value = F.when(F.col("kind") == "Script", request_url(F.col("text"))).otherwise(F.col("text"))
    return rows.select("page_id", "pos", "kind", F.split_part("id", F.lit("_"), F.lit(1)).alias("field"), F.regexp_extract("id", "_(.*)$", 1).alias("no"), value.alias("value"))


def downloads(record: DataFrame, fields: list[str]) -> DataFrame:
    """page_id, no and the fields of each download of browser_record(): its elements, and what its JsonData holds; else "None"."""
    own = record.where("kind = 'Download'")
    plain = own.where("field <> 'JsonData'").select("page_id", "no", "field", "value")
    json = own.where("field = 'JsonData'").select("page_id", "no", F.explode(F.from_json("value", "map<string,string>")).alias("field", "value"))
    wide = plain.unionByName(json).groupBy("page_id", "no").pivot("field", fields).agg(F.max("value"))
    return wide.select("page_id", "no", *(F.coalesce(f, F.lit("None")).alias(f) for f in fields))


def browser_events(rows: DataFrame) -> DataFrame:
    """page_id, requests, scripts (sorted sets), history (in order; empty if under two); rows: of browser_record()."""
    sets = [F.array_sort(F.collect_set(F.when(F.col("kind") == k, F.col("value")))).alias(n) for k, n in (("Request", "requests"), ("Script", "scripts"))]
    visits = F.array_sort(F.collect_list(F.when(F.col("kind") == "History", F.struct("pos", "value"))))
    out = rows.groupBy("page_id").agg(*sets, F.transform(visits, lambda x: x["value"]).alias("history"))
    return out.withColumn("history", F.when(F.size("history") >= 2, F.col("history")).otherwise(F.array().cast("array<string>")))


FETCHED = "url string, final_url string, status int, content_type string, content_length long, body binary, error string"


def http_get(url: str, seconds: float = 10.0) -> dict:
    """One page by the standard library: what the server says, or the error; seconds: of waiting for it."""
    row = dict.fromkeys(name.split()[0] for name in FETCHED.split(", ")) | {"url": url}
    try:
        with urlopen(Request(url, headers={"User-Agent": "pagewatch"}), timeout=seconds) as got:
            body = got.read()
            return row | {"final_url": got.url, "status": got.status, "content_type": got.headers.get("Content-Type", ""), "content_length": len(body), "body": body}
    except HTTPError as e:
        return row | {"final_url": e.url, "status": e.code, "error": str(e)}
    except (OSError, ValueError) as e:
        return row | {"error": str(e)}


def fetched(urls: DataFrame, fetch=http_get) -> DataFrame:
    """FETCHED rows of urls, an optional connector: fetch(url) -> dict, on the executors."""

    def run(frames):
        for frame in frames:
            rows = pd.DataFrame([fetch(u) for u in frame["url"]], columns=[name.split()[0] for name in FETCHED.split(", ")])
            yield rows.astype({"status": "Int32", "content_length": "Int64"})

    return urls.select("url").mapInPandas(run, FETCHED)
