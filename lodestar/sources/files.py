"""Readers: files, documents, benchmark sets, guarded SQL, connector templates."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import text as t

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def discovered(spark: SparkSession, path: str, pattern: str = "*.md", skip: Sequence[str] = (".git", "node_modules", "target", "build")) -> DataFrame:
    """path, name, suffix, length, modified of the files below a folder, by Spark's reader."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    for name in skip:
        rows = rows.where(~F.col("path").contains(f"/{name}/"))
    return rows.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.regexp_extract("path", r"\.([^./]+)$", 1).alias("suffix"), "length", F.col("modificationTime").alias("modified"))


def documents(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, title, text of Markdown, HTML and plain files."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    rows = rows.select("path", F.try_to_binary(F.hex("content"), F.lit("hex")).cast("string").alias("raw"))
    html = F.col("path").rlike(r"(?i)\.html?$")
    name = F.element_at(F.split("path", "/"), -1)
    title = F.when(html, F.regexp_extract("raw", r"(?is)<title[^>]*>(.*?)</title>", 1)).otherwise(t.markdown_title(F.col("raw"), name))
    return rows.select("path", F.when(title == "", name).otherwise(title).alias("title"), F.when(html, t.html_text(F.col("raw"))).otherwise(F.col("raw")).alias("text"))


def from_json(rows: DataFrame, column: str, path: str) -> Column:
    """A value of a JSON text by a path such as ``$.a.b[0]``."""
    return F.get_json_object(column, path)


def all_from_json(column: str, path: str) -> Column:
    """All values below an array, for ``$.items[*].name``."""
    return F.from_json(F.get_json_object(column, path), "array<string>")


def from_xml(column: str, path: str) -> Column:
    """The text at an XPath."""
    return F.xpath_string(column, F.lit(path))


#: Files of a benchmark set and their columns.
BENCHMARK = {
    "corpus.jsonl": "id string, text string, title string, synapticTags array<string>, valence tinyint, importance float, arousal int, sessionId string, timestampMs bigint, entityMentions array<struct<name:string,type:string>>, memoryType string, recallCount int",
    "queries.jsonl": "id string, text string, cognitiveProfile string, synapticFilterTags array<string>, minValence tinyint, maxValence tinyint, expectedSubsystem string, temporalHint string",
    "entities.jsonl": "fromEntity struct<name:string,type:string>, toEntity struct<name:string,type:string>, relationType string, sourceMemoryIds array<string>",
    "hebbian_edges.jsonl": "memoryIdA string, memoryIdB string, coActivationCount int",
    "temporal_chains.jsonl": "sessionId string, orderedMemoryIds array<string>",
}


def benchmark(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a benchmark set by name; judgements as query_id, corpus_id, grade."""
    found = {name.split(".")[0]: spark.read.schema(schema).json(f"{path}/{name}") for name, schema in BENCHMARK.items()}
    found["qrels"] = spark.read.schema("query_id string, corpus_id string, grade int").csv(f"{path}/qrels.tsv", sep="\t", header=True, enforceSchema=True)
    return found


def benchmark_problems(tables: dict[str, DataFrame]) -> DataFrame:
    """kind, n: judgements of unknown queries or records, grades out of range, repeated ids."""
    q, c, r = tables["queries"].select(F.col("id").alias("query_id")), tables["corpus"].select(F.col("id").alias("corpus_id")), tables["qrels"]
    parts = [
        r.join(q, "query_id", "left_anti").select(F.lit("unknown_query").alias("kind")),
        r.join(c, "corpus_id", "left_anti").select(F.lit("unknown_record").alias("kind")),
        r.where(~F.col("grade").between(0, 3)).select(F.lit("grade").alias("kind")),
        tables["corpus"].groupBy("id").count().where("count > 1").select(F.lit("repeated_id").alias("kind")),
    ]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found.groupBy("kind").agg(F.count("*").alias("n"))


def guarded_sql(spark: SparkSession, sf_dir: str, sql: str, allowed: Sequence[str] | None = None, denied: Sequence[str] = ()) -> DataFrame:
    """Run one SELECT over the folder's tables; other statements and tables are refused.

    The tables are taken from the parsed plan, not from the text.
    """
    if not re.match(r"(?is)^\s*(select|with)\b", sql) or ";" in sql.strip().rstrip(";"):
        raise ValueError("one SELECT is allowed")
    session = spark.newSession()
    for name in TABLES:
        if re.search(rf"(?i)\b{name}\b", sql):
            session.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
    plan = session._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    text = plan.toString()
    if re.search(r"(?m)^\W*(Insert|Create|Drop|Alter|Delete|Update|Merge|Truncate)", text):
        raise ValueError("one SELECT is allowed")
    used = {m.lower() for m in re.findall(r"UnresolvedRelation \[([\w., ]+)\]", text)}
    own = set(re.findall(r"(?im)\b(\w+)\s+as\s*\(\s*select\b", sql.lower()))
    for name in used - own:
        if name in {d.lower() for d in denied} or (allowed is not None and name not in {a.lower() for a in allowed}):
            raise ValueError(f"table {name} is not allowed")
    return session.sql(sql)


def hashed_embedder(dimensions: int = 64) -> Callable[[Column], Column]:
    """An embedding without a model: signed counts of hashed words, a unit vector."""
    import numpy as np
    import xxhash

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        result = []
        for text in texts:
            v = np.zeros(dimensions)
            for word in re.findall(r"\w+", (text or "").lower()):
                h = xxhash.xxh64_intdigest(word)
                v[h % dimensions] += 1 if h >> 63 else -1
            n = np.linalg.norm(v)
            result.append((v / n if n else v).astype(np.float32))
        return pd.Series(result)

    return embed


#: Sources by kind: how each is read. Services without a reader in Spark need a plug-in.
CONNECTORS = {
    "file-watch": ("files", ("path",)), "direct": ("frame", ()), "db-query": ("jdbc", ("url", "query")), "kafka-consumer": ("kafka", ("servers", "topic")), "s3-poll": ("files", ("path",)),
    "rest-api-poll": ("http", ("url",)), "webhook": ("json", ("path",)), "github": ("plug-in", ("repository",)), "confluence": ("plug-in", ("space",)), "jira": ("plug-in", ("project",)),
    "notion": ("plug-in", ("database",)), "mongodb-poll": ("plug-in", ("collection",)), "rss": ("http", ("url",)), "salesforce": ("plug-in", ("object",)), "slack": ("plug-in", ("channel",)),
    "sharepoint": ("plug-in", ("site",)), "google-drive": ("plug-in", ("folder",)), "web-scraper": ("http", ("url",)), "notify-slack": ("plug-in", ("channel",)), "notify-email": ("plug-in", ("to",)),
}
_PLUGINS: dict[str, Callable[..., DataFrame]] = {}


def fetched(spark: SparkSession, urls: list[str], schemes: tuple[str, ...] = ("http", "https"), seconds: float = 30.0) -> DataFrame:
    """url, body, problem: each address fetched by the task that has its row."""
    for url in urls:
        if url.split(":", 1)[0].lower() not in schemes:
            raise ValueError(f"address {url} isn't of {', '.join(schemes)}")

    @F.pandas_udf("body string, problem string")
    def get(addresses: pd.Series) -> pd.DataFrame:
        from urllib.request import urlopen

        rows = []
        for address in addresses:
            try:
                with urlopen(address, timeout=seconds) as answer:
                    rows.append((answer.read().decode("utf-8", "replace"), None))
            except OSError as error:
                rows.append((None, str(error)))
        return pd.DataFrame(rows, columns=["body", "problem"])

    return spark.createDataFrame([(u,) for u in urls], "url string").repartition(max(1, len(urls))).select("url", get("url").alias("r")).select("url", "r.*")


def feed_items(pages: DataFrame) -> DataFrame:
    """url, body -> url, title, link, text, published: the items of RSS and Atom feeds."""

    @F.pandas_udf("array<struct<title:string,link:string,text:string,published:string>>")
    def items(bodies: pd.Series) -> pd.Series:
        from xml.etree import ElementTree

        result = []
        for body in bodies:
            found = []
            # A feed has no need of a document type, through which entities could grow without bound.
            if body and "<!DOCTYPE" not in body and "<!ENTITY" not in body:
                try:
                    tree = ElementTree.fromstring(body)
                except ElementTree.ParseError:
                    tree = ElementTree.Element("none")
                for node in tree.iter():
                    if node.tag.rpartition("}")[2] not in ("item", "entry"):
                        continue
                    own = {k.tag.rpartition("}")[2]: k for k in node}
                    text = lambda *names, own=own: next((own[n].text for n in names if n in own and own[n].text), None)
                    link = text("link") or (own["link"].get("href") if "link" in own else None)
                    found.append({"title": text("title"), "link": link, "text": text("description", "summary", "content"), "published": text("pubDate", "published", "updated")})
            result.append(found)
        return pd.Series(result, dtype=object)

    return pages.select("url", F.explode(items("body")).alias("i")).select("url", "i.*")


def rest_items(pages: DataFrame, path: str = "$") -> DataFrame:
    """url, body -> url, item: the elements (as JSON) of the array at a path of the answer."""
    array = F.from_json(F.get_json_object("body", path), "array<variant>")
    return pages.select("url", F.explode(array).alias("v")).select("url", F.to_json("v").alias("item"))


def plug_in(kind: str, reader: Callable[..., DataFrame]) -> None:
    """Register a reader (spark, options) for a kind of source."""
    _PLUGINS[kind] = reader


def connected(spark: SparkSession, kind: str, stream: bool = False, **options) -> DataFrame:
    """Rows of a source by its kind."""
    if kind not in CONNECTORS:
        raise ValueError(f"unknown connector {kind}")
    how, needed = CONNECTORS[kind]
    missing = [n for n in needed if n not in options]
    if missing:
        raise ValueError(f"connector {kind} needs {', '.join(missing)}")
    reader = spark.readStream if stream else spark.read
    if how == "files":
        return reader.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", options.get("pattern", "*")).load(options["path"])
    if how == "json":
        # What a gateway has received lies as JSON lines in a folder.
        return reader.schema(options.get("schema", "id string, text string, received string")).json(options["path"])
    if how == "http":
        urls = [options["url"]] if isinstance(options["url"], str) else list(options["url"])
        pages = fetched(spark, urls, options.get("schemes", ("http", "https")))
        if kind == "rss":
            return feed_items(pages)
        return rest_items(pages, options.get("items", "$")) if kind == "rest-api-poll" else pages.select("url", t.html_text(F.col("body")).alias("text"))
    if how == "jdbc":
        return spark.read.format("jdbc").options(url=options["url"], query=options["query"]).load()
    if how == "kafka":
        return reader.format("kafka").options(**{"kafka.bootstrap.servers": options["servers"], "subscribe": options["topic"]}).load()
    if how == "frame":
        return options["frame"]
    if kind not in _PLUGINS:
        raise ValueError(f"connector {kind} needs a plug-in")
    return _PLUGINS[kind](spark, options)
