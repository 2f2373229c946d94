"""Queries of tokenizer fingerprints, on vocabularies made of the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.operators import fingerprints
from turnloom.sources.adapter import read

COMPONENTS = ["vocab", "merges", "added", "backend"]


def _tables(spark: SparkSession, sf_dir: str, changed: bool) -> dict[str, DataFrame]:
    """Fifty models, whose tokens and merges are documents' ids and lengths; changed: as another server reports some of them."""
    d = read(spark, sf_dir, "documents").selectExpr("concat('m', doc_id % 50) AS owner", "doc_id % 50 AS o", "doc_id", "n_chars", "source", "lang")
    swap = f"{str(changed).lower()} AND "
    id = f"if({swap} o % 5 = 1 AND doc_id < 50, doc_id + 1, doc_id)"
    raw = f"if(doc_id % 2 = 0, concat('\"', n_chars, ' x\\\\u0041', doc_id, '\"'), concat('[ \"', n_chars, '\" , \"xA', doc_id, '\"]'))"
    place = f"if({swap} o % 5 = 2 AND doc_id < 100, 100 - doc_id, doc_id)"
    flag = f"if({swap} o % 7 = 2, true, cast(null AS boolean))"
    added = d.groupBy("owner", "o", "lang").agg(F.min("doc_id").alias("id")).selectExpr("owner", "id", "coalesce(lang, '-') AS content", "false AS special", f"{flag} AS lstrip", "false AS rstrip", "true AS single_word", "false AS normalized")
    backend = d.select("owner", "o").distinct().selectExpr("owner", "0 AS place", f"""if({swap} true, concat('{{"b": [', o, ', true], "a": 1.50}}'), concat('{{"a":1.5,"b":[', o, ',true]}}')) AS raw""")
    return {
        "vocab": fingerprints.vocabulary(d.selectExpr("owner", "concat('t', doc_id) AS token", f"{id} AS id")), "merges": fingerprints.merges(d.selectExpr("owner", f"{place} AS place", f"{raw} AS raw")),
        "added": fingerprints.added(added), "backend": fingerprints.documents(backend),
    }


def tokenizer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roots of each model's components and its fingerprint."""
    d = fingerprints.fingerprints(_tables(spark, sf_dir, False), "v1", "c0")
    return d.select("owner", *COMPONENTS, *[f"n_{c}" for c in COMPONENTS], "fingerprint")


def fingerprint_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What other servers report against the local models: by component, or why no comparison is made."""
    local = fingerprints.fingerprints(_tables(spark, sf_dir, False), "v1", "c0")
    remote = fingerprints.fingerprints(_tables(spark, sf_dir, True), "v1", "c0").withColumn("o", F.expr("int(substr(owner, 2))"))
    remote = remote.withColumn("corpus", F.when(F.col("o") % 17 == 3, "c1").otherwise(F.col("corpus"))).withColumn("pin", F.when(F.col("o") % 13 != 5, "p")).where("o % 11 <> 4").drop("o")
    return fingerprints.agreement(local, remote, COMPONENTS)


def _tree(leaves: str, order: str) -> str:
    """SQL for DuckDB of a component's root and leaves from (owner, leaf, ...)."""
    fan = fingerprints.FAN
    level = lambda inner: f"SELECT owner, p // {fan} AS p, sha256(string_agg(h, '' ORDER BY p)) AS h, sum(n) AS n FROM ({inner}) x GROUP BY owner, p // {fan}"
    base = f"SELECT owner, row_number() OVER (PARTITION BY owner ORDER BY {order}) - 1 AS p, sha256(leaf) AS h, 1 AS n FROM ({leaves}) y"
    for _ in range(fingerprints.LEVELS):
        base = level(base)
    return f"(SELECT owner, sha256(string_agg(h, '' ORDER BY p)) AS root, CAST(sum(n) AS BIGINT) AS n FROM ({base}) z GROUP BY owner)"


_D = "(SELECT concat('m', doc_id % 50) AS owner, doc_id % 50 AS o, * FROM documents) d"
_ROOTS = {
    "vocab": _tree(f"""SELECT owner, doc_id, concat('["t', doc_id, '","', doc_id, '"]') AS leaf FROM {_D}""", "concat('t', doc_id)"),
    "merges": _tree(f"""SELECT owner, doc_id, concat('["', n_chars, '","xA', doc_id, '"]') AS leaf FROM {_D}""", "doc_id"),
    "added": _tree(f"""SELECT owner, min(doc_id) AS id, concat('{{"id":', min(doc_id), ',"content":"', coalesce(lang, '-'), '","special":false,"lstrip":false,"rstrip":false,"single_word":true,"normalized":false}}') AS leaf FROM {_D} GROUP BY owner, lang""", "id"),
    "backend": _tree(f"""SELECT DISTINCT owner, concat('{{"a":1.5,"b":[', o, ',true]}}') AS leaf FROM {_D}""", "leaf"),
}
_JSON = " || ".join(f"""',"{k}":"' || {k}.root || '","n_{k}":' || {k}.n""" for k in sorted(COMPONENTS))
QUERIES = {"tokenizer_fingerprints": tokenizer_fingerprints, "fingerprint_agreement": fingerprint_agreement}
ORACLE = {
    "tokenizer_fingerprints": f"""SELECT vocab.owner, {', '.join(f'{k}.root AS {k}, {k}.n AS n_{k}' for k in COMPONENTS)}, sha256('{{"algorithm":"v1","corpus":"c0"' || {_JSON} || '}}') AS fingerprint
        FROM {_ROOTS['vocab']} vocab {' '.join(f'JOIN {_ROOTS[k]} {k} ON {k}.owner = vocab.owner' for k in COMPONENTS[1:])}""",
    "fingerprint_agreement": """SELECT DISTINCT concat('m', o) AS owner, CASE WHEN o % 11 = 4 THEN 'model' WHEN o % 17 = 3 THEN 'protocol' WHEN o % 5 = 1 AND o % 7 = 2 THEN 'vocab,added' WHEN o % 5 = 2 AND o % 7 = 2 THEN 'merges,added' WHEN o % 5 = 1 THEN 'vocab' WHEN o % 5 = 2 THEN 'merges' WHEN o % 7 = 2 THEN 'added'
        WHEN o % 13 = 5 THEN 'pin' ELSE 'ok' END AS verdict FROM (SELECT doc_id % 50 AS o FROM documents) q""",
}
