"""Catalog tables derived from parts, documents, customers and suppliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog import manifests as M
from tidemark.catalog import search as S
from tidemark.functions.paths import split_reference, split_repository
from tidemark.functions.versions import highest_version, satisfies
from tidemark.queries.registry import events, query, scratch, table
from tidemark.sources import listing

_VERSION_SQL = "(p_size % 4) || '.' || (p_partkey % 10) || '.' || (p_partkey % 7)"


def _version():
    return F.concat_ws(
        ".", F.pmod("p_size", F.lit(4)), F.pmod("p_partkey", F.lit(10)), F.pmod("p_partkey", F.lit(7))
    )


def _datasets(spark, sf_dir):
    k = F.col("p_partkey")
    technique = F.concat(F.when(F.pmod(k, F.lit(11)) == 0, "X").otherwise("T"), 1000 + F.pmod(k, F.lit(50)))
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("set-"), k).alias("name"), F.col("p_name").alias("description"),
        F.when(F.pmod(k, F.lit(13)) == 0, "latest").otherwise(_version()).alias("version"),
        F.array("p_brand", F.lower("p_type")).alias("tags"),
        F.array(F.struct(technique.alias("id"), F.concat(F.lit("Use of "), "p_type").alias("name"))).alias("techniques"),
        F.array(F.concat(F.lit("tactic "), F.pmod(k, F.lit(6)))).alias("tactics"),
        F.concat(F.lit("repo"), F.pmod(k, F.lit(5))).alias("repository"),
        (F.pmod(k, F.lit(5)) != 3).alias("enabled"),
    )


@query("catalog_list", """
SELECT 'set-' || p_partkey AS name FROM part WHERE p_partkey % 5 = 2 AND p_partkey % 5 <> 3
  AND (p_brand = 'Brand#3' OR lower(p_type) IN ('economy', 'Brand#3'))""")
def catalog_list(spark, sf_dir):
    found = S.list_datasets(_datasets(spark, sf_dir), "repo2", ["Brand#3", "economy"])
    return found.select("name")


@query("catalog_by_technique", """
SELECT 'set-' || p_partkey AS name FROM part WHERE p_partkey % 5 <> 3 AND p_partkey % 50 = 7 AND p_partkey % 11 <> 0""")
def catalog_by_technique(spark, sf_dir):
    return S.list_datasets(_datasets(spark, sf_dir), technique="T1007").select("name")


@query("catalog_search", """
SELECT 'set-' || p_partkey AS name, p_name AS description FROM part
WHERE lower(p_name) LIKE '%red%' OR lower(p_brand) LIKE '%red%' OR lower(p_type) LIKE '%red%'""")
def catalog_search(spark, sf_dir):
    """In any letter case, in name, description, tags, techniques and tactics."""
    return S.search_datasets(_datasets(spark, sf_dir), "ReD").select("name", "description")


@query("catalog_search_techniques", """
SELECT 'set-' || p_partkey AS name FROM part
WHERE 'tactic ' || (p_partkey % 6) = 'tactic 4' OR lower('Use of ' || p_type) LIKE '%tactic 4%'""")
def catalog_search_techniques(spark, sf_dir):
    return S.search_datasets(_datasets(spark, sf_dir), "TACTIC 4", ["mitre_attack"]).select("name")


@query("dataset_violations", """
SELECT 'set-' || p_partkey AS name, concat_ws(',', CASE WHEN p_partkey % 13 = 0 THEN 'version is not semantic' END,
  CASE WHEN p_partkey % 11 = 0 THEN 'technique id does not start with T' END) AS violations FROM part""")
def dataset_violations(spark, sf_dir):
    checked = S.dataset_violations(_datasets(spark, sf_dir))
    return checked.select("name", F.array_join("violations", ",").alias("violations"))


def _files(spark, sf_dir):
    """A file per document: bundled or referenced, some with broken entries."""
    i = F.col("doc_id")
    bundled = F.pmod(i, F.lit(3)) != 0
    path = (
        F.when(bundled & (F.pmod(i, F.lit(17)) == 1), F.concat(F.lit("logs/../"), i))
        .when(bundled, F.concat_ws("/", "lang", "source", F.concat(i, F.lit(".jsonl"))))
        .when(F.pmod(i, F.lit(6)) == 0, F.concat(F.lit("s3://bucket/"), i))
        .otherwise(F.concat(F.lit("ftp://host/"), i))
    )
    digest = F.concat(F.lit("sha256:"), F.sha2(F.col("text").cast("binary"), 256))
    return table(spark, sf_dir, "documents").select(
        F.concat_ws("-", "lang", "source").alias("dataset"),
        F.when(bundled, "bundled").otherwise("references").alias("kind"), path.alias("path"),
        F.when(F.pmod(i, F.lit(19)) == 0, "parquet").otherwise("jsonl").alias("format"),
        F.when(F.pmod(i, F.lit(23)) == 0, "crc:1").when(~bundled, digest).alias("checksum"),
        F.when(F.pmod(i, F.lit(4)) != 0, F.concat(F.lit("st:"), "source")).alias("sourcetype"),
        F.when(bundled, F.col("n_chars")).alias("event_count"),
        F.struct(
            F.col("lang").alias("vendor"), F.col("source").alias("product"),
            F.lit(None).cast("string").alias("category"), F.lit(None).cast("string").alias("subcategory"),
        ).alias("log_source"),
        F.create_map(F.lit("siem"), F.to_variant_object(F.struct(F.col("source").alias("index")))).alias("platforms"),
        "doc_id", "text",
    )


_FILE_SQL = """
f AS (SELECT doc_id, lang, source, text, n_chars, doc_id % 3 <> 0 AS bundled, lang || '-' || source AS dataset FROM documents)"""


@query("file_violations", f"""
WITH {_FILE_SQL}
SELECT doc_id, concat_ws(',', CASE WHEN bundled AND doc_id % 17 = 1 THEN 'path leaves the dataset' END,
  CASE WHEN NOT bundled AND doc_id % 6 <> 0 THEN 'address scheme is not supported' END,
  CASE WHEN doc_id % 19 = 0 THEN 'format is unknown' END,
  CASE WHEN doc_id % 23 = 0 THEN 'checksum is not algorithm:value' END) AS violations FROM f""")
def file_violations(spark, sf_dir):
    checked = S.file_violations(_files(spark, sf_dir))
    return checked.select("doc_id", F.array_join("violations", ",").alias("violations"))


@query("checksum_matches", f"""
WITH {_FILE_SQL} SELECT doc_id, NOT (doc_id % 23 = 0) AS ok FROM f""")
def checksum_matches(spark, sf_dir):
    """Declared checksums against the whole content; nothing declared passes."""
    ok = listing.checksum_matches(F.col("text").cast("binary"), F.col("checksum"))
    return _files(spark, sf_dir).select("doc_id", ok.alias("ok"))


@query("missing_files", f"""
WITH {_FILE_SQL} SELECT doc_id FROM f WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def missing_files(spark, sf_dir):
    """Manifest entries that a listing (here: the labelled documents) does not have."""
    manifest = _files(spark, sf_dir).select("doc_id", F.col("doc_id").cast("string").alias("path"))
    listed = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("path"))
    return listing.missing_files(manifest, listed).select("doc_id")


@query("dataset_info", f"""
WITH {_FILE_SQL}
SELECT dataset AS name, count(*) FILTER (bundled) AS bundled_files, count(*) FILTER (NOT bundled) AS "references",
       sum(n_chars) FILTER (bundled)::BIGINT AS events,
       string_agg(DISTINCT CASE WHEN doc_id % 4 <> 0 THEN 'st:' || source END, ',') AS sourcetypes,
       2::BIGINT AS dependencies FROM f GROUP BY dataset""")
def dataset_info(spark, sf_dir):
    files = _files(spark, sf_dir)
    datasets = files.select(F.col("dataset").alias("name")).distinct().select(
        "name", F.lit("1.0.0").alias("version"), F.lit("").alias("description"),
        F.array().cast("array<string>").alias("techniques"),
    )
    dependencies = datasets.select(F.col("name").alias("dataset"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("dependency"))
    info = S.dataset_info(datasets, files, dependencies)
    return info.select(
        "name", "bundled_files", "references", "events",
        F.nullif(F.array_join("sourcetypes", ","), F.lit("")).alias("sourcetypes"), "dependencies",
    )


@query("log_sources", f"""
WITH {_FILE_SQL} SELECT lang AS vendor, source AS product, count(*) AS files, count(DISTINCT dataset) AS datasets
FROM f GROUP BY lang, source""")
def log_sources(spark, sf_dir):
    return S.log_sources(_files(spark, sf_dir)).select("vendor", "product", "files", "datasets")


@query("platform_metadata", f"""
WITH {_FILE_SQL} SELECT dataset, 'siem' AS platform, '{{"index":"' || source || '"}}' AS settings, count(*) AS files
FROM f GROUP BY ALL""")
def platform_metadata(spark, sf_dir):
    rows = S.platform_metadata(_files(spark, sf_dir))
    return rows.groupBy("dataset", "platform", "settings").agg(F.count(F.lit(1)).alias("files"))


@query("largest_file", """
SELECT doc_id::VARCHAR AS path, n_chars * CASE WHEN doc_id % 7 = 0 THEN 10 ELSE 1 END AS estimated_size
FROM documents ORDER BY 2 DESC, 1 LIMIT 1""")
def largest_file(spark, sf_dir):
    """The file with the largest size when unpacked."""
    files = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("path"), F.col("n_chars").alias("size"),
        F.concat("doc_id", F.when(F.pmod("doc_id", F.lit(7)) == 0, ".gz").otherwise(".log")).alias("file_name"),
    )
    return listing.largest_file(files).select("path", "estimated_size")


@query("files_within_size", """
SELECT doc_id FROM documents WHERE n_chars * CASE WHEN doc_id % 7 = 0 THEN 10 ELSE 1 END <= 3000""")
def files_within_size(spark, sf_dir):
    files = table(spark, sf_dir, "documents").select(
        "doc_id", F.col("n_chars").alias("size"),
        F.concat("doc_id", F.when(F.pmod("doc_id", F.lit(7)) == 0, ".gz").otherwise(".log")).alias("file_name"),
    )
    return listing.within_size(files, 3000).select("doc_id")


# ---------------------------------------------------------------------------------------------
# versions and references

_CONSTRAINTS = ("*", "1.x", "2.3.X", "^1.2.3", "~2.4.1", ">=2.0.0", "<=1.5.0", ">1.9.0", "<0.4.0", "=3.1.1", "v1.1.1", "1.y")


@query("version_constraints", f"""
WITH v AS (SELECT p_partkey, p_partkey % 12 AS c, p_size % 4 AS a, p_partkey % 10 AS b, p_partkey % 7 AS p,
  p_partkey % 13 = 0 AS junk FROM part)
SELECT p_partkey, CASE WHEN c = 0 THEN true WHEN junk OR c = 11 THEN NULL ELSE CASE c
  WHEN 1 THEN a = 1 WHEN 2 THEN a = 2 AND b = 3 WHEN 3 THEN a = 1 AND (b, p) >= (2, 3) WHEN 4 THEN a = 2 AND b = 4 AND p >= 1
  WHEN 5 THEN (a, b, p) >= (2, 0, 0) WHEN 6 THEN (a, b, p) <= (1, 5, 0) WHEN 7 THEN (a, b, p) > (1, 9, 0)
  WHEN 8 THEN (a, b, p) < (0, 4, 0) WHEN 9 THEN (a, b, p) = (3, 1, 1) ELSE (a, b, p) = (1, 1, 1) END END AS fits FROM v""")
def version_constraints(spark, sf_dir):
    k = F.col("p_partkey")
    version = F.when(F.pmod(k, F.lit(13)) == 0, "latest").otherwise(F.concat(F.lit("v"), _version(), F.lit("-rc1")))
    constraint = F.get(F.array(*[F.lit(c) for c in _CONSTRAINTS]), F.pmod(k, F.lit(12)).cast("int"))
    return table(spark, sf_dir, "part").select(k, satisfies(version, constraint).alias("fits"))


@query("highest_version", f"""
WITH v AS (SELECT p_brand, {_VERSION_SQL} AS version, p_size % 4 AS a, p_partkey % 10 AS b, p_partkey % 7 AS p FROM part)
SELECT p_brand, arg_max(version, a * 10000 + b * 100 + p) AS version FROM v WHERE (a, b, p) >= (1, 2, 0) AND a = 1 GROUP BY p_brand""")
def highest_version_of(spark, sf_dir):
    """The highest release per brand that fits a constraint."""
    releases = table(spark, sf_dir, "part").select("p_brand", _version().alias("version"))
    return highest_version(releases, "p_brand", "version", F.lit("^1.2.0"))


@query("dataset_references", """
SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'org/' || p_partkey WHEN 1 THEN 'org/repo/' || p_partkey
  WHEN 2 THEN '/data/' || p_partkey WHEN 3 THEN 'https://host/' || p_partkey || '@1' WHEN 4 THEN 's3://b/' || p_partkey
  ELSE 'gs://b/x@y' END AS path,
  CASE p_partkey % 6 WHEN 1 THEN 'v1.' || p_partkey WHEN 5 THEN '2.0.0' END AS version,
  CASE p_partkey % 6 WHEN 1 THEN 'github' WHEN 2 THEN 'local' WHEN 3 THEN 'https' WHEN 4 THEN 's3' WHEN 5 THEN 'gs' END AS scheme
FROM part""")
def dataset_references(spark, sf_dir):
    k = F.col("p_partkey").cast("string")
    kinds = (
        F.concat(F.lit("org/"), k), F.concat(F.lit("github:org/repo/"), k, F.lit("@v1."), k),
        F.concat(F.lit("local:/data/"), k), F.concat(F.lit("https://host/"), k, F.lit("@1")),
        F.concat(F.lit("s3://b/"), k), F.lit("gs://b/x@y@2.0.0"),
    )
    ref = F.get(F.array(*kinds), F.pmod("p_partkey", F.lit(6)).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", split_reference(ref).alias("r")).select("p_partkey", "r.*")


@query("repository_references", """
SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 'org' END AS org,
  CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 'r' || p_partkey END AS repo,
  CASE p_partkey % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'a/b' END AS path,
  CASE p_partkey % 3 WHEN 2 THEN '1.0.0' END AS version FROM part""")
def repository_references(spark, sf_dir):
    k = F.col("p_partkey").cast("string")
    kinds = (F.concat(F.lit("short"), k), F.concat(F.lit("org/r"), k), F.concat(F.lit("org/r"), k, F.lit("/a/b@1.0.0")))
    ref = F.get(F.array(*kinds), F.pmod("p_partkey", F.lit(3)).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", split_repository(ref).alias("r")).select("p_partkey", "r.*")


@query("source_addresses", """
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 's3' WHEN 1 THEN 'gcs' WHEN 2 THEN 'gcs' WHEN 3 THEN 'azure' ELSE 'local' END AS kind,
  CASE WHEN p_partkey % 5 < 4 THEN 'bkt' END AS bucket,
  CASE p_partkey % 5 WHEN 4 THEN '/logs/' || p_partkey WHEN 3 THEN '' ELSE 'p/' || p_partkey END AS prefix,
  CASE p_partkey % 5 WHEN 0 THEN 's3a://bkt/p/' || p_partkey WHEN 1 THEN 'gs://bkt/p/' || p_partkey
    WHEN 2 THEN 'gs://bkt/p/' || p_partkey WHEN 3 THEN 'abfss://bkt' ELSE '/logs/' || p_partkey END AS hadoop_uri
FROM part""")
def source_addresses(spark, sf_dir):
    k = F.col("p_partkey").cast("string")
    kinds = (
        F.concat(F.lit("s3://bkt/p/"), k), F.concat(F.lit("gs://bkt/p/"), k), F.concat(F.lit("gcs://bkt/p/"), k),
        F.lit("azure://bkt"), F.concat(F.lit("/logs/"), k),
    )
    uri = F.get(F.array(*kinds), F.pmod("p_partkey", F.lit(5)).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", listing.split_uri(uri).alias("u")).select("p_partkey", "u.*")


@query("profile_list", """
SELECT c_name AS name, (c_custkey % 4 + 1)::INT AS datasets_count FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')""")
def profile_list(spark, sf_dir):
    profiles = table(spark, sf_dir, "customer").select(
        F.col("c_name").alias("name"), F.array("c_mktsegment").alias("tags"),
        F.sequence(F.lit(0), F.pmod("c_custkey", F.lit(4)).cast("int")).alias("datasets"),
    )
    return S.list_profiles(profiles, ["BUILDING", "MACHINERY"]).select("name", "datasets_count")


@query("destination_list", """
SELECT s_name AS name FROM supplier WHERE s_nationkey % 4 = 1""")
def destination_list(spark, sf_dir):
    kinds = F.array(*[F.lit(x) for x in ("local", "s3", "gcs", "azure")])
    destinations = table(spark, sf_dir, "supplier").select(
        F.col("s_name").alias("name"), F.get(kinds, F.pmod("s_nationkey", F.lit(4)).cast("int")).alias("type")
    )
    return S.list_destinations(destinations, "s3").select("name")


def _manifest_folder(spark, sf_dir):
    """A manifest per nation, as JSON or YAML by turns; every fifth cannot be used."""
    folder = scratch(spark)
    key = F.col("n_nationkey")
    counts = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    rows = table(spark, sf_dir, "nation").join(counts, key == F.col("c_nationkey"))
    as_json = F.concat(
        F.lit('{"metadata":{"name":"set-'), key,
        F.lit('","version":"1.0.0","description":"d","mitre_attack":{"techniques":[{"id":"T1","name":"n"}]}},'
              '"files":{"bundled":[{"path":"a.jsonl","event_count":'), "n", F.lit(',"sourcetype":"st:'), key,
        F.lit('"}]},"dependencies":[{"dataset":"other","version":">=1.0.0"}]}'),
    )
    as_yaml = F.concat(
        F.lit("metadata:\n  name: set-"), key, F.lit("\n  version: 1.0.0\n  description: d\n  mitre_attack:\n"
        "    techniques:\n      - {id: T1, name: n}\nfiles:\n  bundled:\n    - path: a.jsonl\n      event_count: "), "n",
        F.lit("\n      sourcetype: 'st:"), key, F.lit("'\ndependencies:\n  - {dataset: other, version: '>=1.0.0'}"),
    )
    kind = F.pmod(key, F.lit(10))
    text = F.when(kind == 4, "{").when(kind == 9, "metadata: {version: 1.0.0}").when(F.pmod(key, F.lit(2)) == 0, as_json).otherwise(as_yaml)
    rows.select(F.col("n_nationkey").alias("nation"), text.alias("value")).write.partitionBy("nation").text(folder)
    return folder


@query("catalog_ingest", """
SELECT 'set-' || c_nationkey AS dataset, count(*) AS event_count, 'st:' || c_nationkey AS sourcetype,
       'T1' AS technique, 'other' AS dependency, '>=1.0.0' AS version
FROM customer WHERE c_nationkey % 5 <> 4 GROUP BY c_nationkey""")
def catalog_ingest(spark, sf_dir):
    """Manifests as JSON and YAML, some unusable, written as files and read into tables."""
    manifests = M.read_manifests(spark, _manifest_folder(spark, sf_dir), "*.txt")
    as_json = manifests.select("manifest")
    files, techniques, needs = M.files(as_json), M.techniques(as_json), M.dependencies(as_json)
    return (
        files.select("dataset", "event_count", "sourcetype")
        .join(techniques.select("dataset", "technique"), "dataset")
        .join(needs.select("dataset", "dependency", "version"), "dataset")
    )


@query("manifest_problems", """
SELECT DISTINCT c_nationkey AS nation, CASE WHEN c_nationkey % 10 = 4 THEN 'cannot be parsed' ELSE 'has no name' END AS problem
FROM customer WHERE c_nationkey % 5 = 4""")
def manifest_problems(spark, sf_dir):
    """Unusable manifests are rows with a reason."""
    found = M.manifest_problems(spark, _manifest_folder(spark, sf_dir), "*.txt")
    return found.select(F.regexp_extract("path", r"nation=(\d+)", 1).cast("int").alias("nation"), "problem")


@query("stored_datasets", """
SELECT DISTINCT 'set-' || c_nationkey AS name, '1.0.0' AS version, 'd' AS description, c_nationkey AS nation
FROM customer WHERE c_nationkey % 5 <> 4""")
def stored_datasets(spark, sf_dir):
    """The datasets below a folder."""
    found = M.listing(M.read_manifests(spark, _manifest_folder(spark, sf_dir), "*.txt"))
    place = F.regexp_extract("path", r"nation=(\d+)", 1).cast("int").alias("nation")
    return found.select("name", "version", "description", place)
