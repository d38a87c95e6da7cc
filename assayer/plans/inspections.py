"""Registered queries over companions, runtimes, knowledge, digests, templates, scanners and reports, with their SQL.

Names, texts and facts are made from ids of the driver's tables, alike in both engines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from assayer.functions import companion, templates
from assayer.operators import companion_scan, digests, knowledge, reports, runtimes, structure, template_findings, verdict
from assayer.plans.registry import _findings_sql, document_findings, query, read
from assayer.sources import scanners


def one_of(key: str, values) -> Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), (F.col(key) % len(values) + 1).cast("int"))


def lit(v) -> str:
    return "NULL" if v is None else "'" + str(v).replace("'", "''") + "'"


def one_of_sql(key: str, values) -> str:
    return f"[{', '.join(map(lit, values))}][{key} % {len(values)} + 1]"


def listed(values) -> str:
    return ", ".join(map(lit, values))


# Companions.
NAMES = ("config.json", "Modelfile", "README.md", "adapter_model.safetensors", "manifest.yaml", "x.py", ".cursorrules", "docs/rules.md", "notes.TXT", "weights.gguf", "a.exe", "model-q0_k.bin", "lib.so", "adapter.bin", "key.pem", ".github/copilot-instructions.md", "sub/run.sh", "MODEL_CARD.md", "adapter.txt", "Manifest.json", "noext", ".md")
_BASE = "lower(regexp_extract(path, '([^/]*)$', 1))"
_SUFFIX = f"regexp_extract({_BASE}, '^.+([.][^.]+)$', 1)"
_FLAGS = {
    "rules_file": f"({_BASE} IN ({listed(companion.RULE_FILES)}) OR lower(path) = '{companion.INSTRUCTIONS}' OR ends_with(lower(path), '/{companion.INSTRUCTIONS}'))",
    "adapter": f"(contains({_BASE}, 'adapter') AND {_SUFFIX} IN ({listed(companion.ADAPTER_SUFFIXES)}))",
    "manifest": f"contains({_BASE}, 'manifest')",
    "model_card": f"({_SUFFIX} = '.md' AND regexp_matches({_BASE}, 'readme|model_card|dataset_card'))",
}
_FLAGS["companion"] = f"({_BASE} IN ({listed(companion.NAMES)}) OR starts_with({_BASE}, 'readme') OR {_FLAGS['manifest']} OR {_SUFFIX} IN ('.py', {listed(companion.READ_SUFFIXES)}) OR {_FLAGS['adapter']} OR {_FLAGS['rules_file']})"


@query("companion_classes", f"WITH f AS (SELECT doc_id, {one_of_sql('doc_id', NAMES)} AS path FROM documents) SELECT doc_id, {', '.join(f'{e} AS {n}' for n, e in _FLAGS.items())} FROM f")
def companion_classes(spark, sf_dir):
    f, p = read(spark, sf_dir, "documents").select("doc_id", one_of("doc_id", NAMES).alias("path")), F.col("path")
    return f.select("doc_id", companion.is_rules_file(p).alias("rules_file"), companion.is_adapter(p).alias("adapter"), companion.is_manifest(p).alias("manifest"), companion.is_model_card(p).alias("model_card"), companion.is_companion(p).alias("companion"))


@query("companion_names", f"WITH f AS (SELECT source AS folder, doc_id, {one_of_sql('doc_id', NAMES)} AS path FROM documents), t AS (SELECT *, path AS name FROM f WHERE NOT contains(path, '/')) SELECT folder, path, 'suspicious_file_type' AS kind FROM t WHERE {_SUFFIX} IN ({listed(companion.PROGRAM_SUFFIXES)}) UNION ALL SELECT folder, path, 'impossible_quantization' FROM t WHERE regexp_matches(name, '(?i)Q0_[KS]|Q0_0|Q1_[KS]')")
def companion_names(spark, sf_dir):
    return companion_scan.name_signals(read(spark, sf_dir, "documents").select(F.col("source").alias("folder"), one_of("doc_id", NAMES).alias("path")))


_PIN = "a" * 64
JSONS = ('{"auto_map": {"AutoModel": "x.Y"}, "n": 1}', '{"b": [1, {"trust_remote_code": true}], "a": "https://x.example/m"}', f'{{"m": {{"u": "hf://x/y@sha256:{_PIN}"}}}}', '{"auto_map": {}, "trust_remote_code": "true"}', '{"k": [[null, "huggingface.co/x"]]}', "[1, 2]", '{"auto_map": [1]}', "not json")
_TREE = f"d AS (SELECT doc_id, {one_of_sql('doc_id', JSONS)} AS t FROM documents), j AS (SELECT doc_id, t FROM d WHERE json_valid(t)), m AS (SELECT j.doc_id, replace(e.fullkey, '\"', '') AS json_path, CASE WHEN regexp_matches(e.fullkey, '\\]$') THEN NULL ELSE replace(e.key, '\"', '') END AS key, e.type AS kind, e.atom AS atom, e.value AS value FROM j, json_tree(j.t) e WHERE e.fullkey <> '$')"


@query("json_members", f"WITH {_TREE} SELECT doc_id, json_path, key, CASE kind WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE 'number' END AS kind FROM m UNION ALL SELECT doc_id, '$', NULL, 'error' FROM d WHERE NOT json_valid(t)")
def json_members(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", one_of("doc_id", JSONS).alias("t"))
    return companion_scan.walk_json(docs, "t").select("doc_id", "json_path", "key", "kind")


_REMOTE_SQL, _PINNED_SQL = "regexp_matches(CAST(value AS VARCHAR), '(?i)https?://|hf://|huggingface\\.co/')", "regexp_matches(CAST(value AS VARCHAR), '(?i)(@|:|\\b)sha256[:=]?[0-9a-f]{64}\\b')"


@query("json_signals", f"""WITH {_TREE} SELECT doc_id, json_path, 'auto_map' AS signal, 'low' AS severity FROM m WHERE key = 'auto_map' AND CAST(value AS VARCHAR) NOT IN ('null', 'false', '0', '""', '{{}}', '[]')
 UNION ALL SELECT doc_id, json_path, 'trust_remote_code', 'low' FROM m WHERE key = 'trust_remote_code' AND kind = 'BOOLEAN' AND CAST(value AS VARCHAR) = 'true'
 UNION ALL SELECT doc_id, json_path, CASE WHEN {_PINNED_SQL} THEN 'remote_reference_pinned' ELSE 'remote_reference_unpinned' END, CASE WHEN {_PINNED_SQL} THEN 'info' ELSE 'low' END FROM m WHERE kind = 'VARCHAR' AND {_REMOTE_SQL}
 UNION ALL SELECT doc_id, '$', 'error', 'info' FROM d WHERE NOT json_valid(t)""")
def json_signals(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", one_of("doc_id", JSONS).alias("t"))
    return companion_scan.json_signals(companion_scan.walk_json(docs, "t")).select("doc_id", "json_path", "signal", "severity")


FROMS = ("FROM ./local.gguf\nfrom https://x.example/m # c", f"PARAMETER x\n FROM 'hf://x/y@sha256:{_PIN}'", 'FROM "llama3"', "# FROM x\nXFROM y", "FROM /abs\nFROM ../up\nFROM file://z")


@query("modelfile_sources", f"WITH d AS (SELECT doc_id, text || chr(10) || {one_of_sql('doc_id', FROMS)} AS t FROM documents), r AS (SELECT doc_id, regexp_replace(unnest(regexp_extract_all(t, '(?im)^\\s*FROM\\s+([^\\s#]+)', 1)), '^[\"'']+|[\"'']+$', '', 'g') AS reference FROM d) SELECT doc_id, reference, regexp_matches(reference, '(?i)(@|:|\\b)sha256[:=]?[0-9a-f]{{64}}\\b') AS pinned FROM r WHERE NOT (starts_with(reference, './') OR starts_with(reference, '../') OR starts_with(reference, '/') OR starts_with(reference, 'file://'))")
def modelfile_sources(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", F.explode(companion.from_sources(F.concat("text", F.lit("\n"), one_of("doc_id", FROMS)))).alias("reference"))
    return docs.withColumn("pinned", companion.is_pinned(F.col("reference")))


REFS = ('a: "https://x.example/1", ', f"see hf://x/y@sha256:{_PIN}\nand\nHuggingFace.co/z", "nothing", "u: 'http://y.example'\n", "p: https://" + "z" * 600)


@query("manifest_references", f"WITH d AS (SELECT doc_id, text || chr(10) || {one_of_sql('doc_id', REFS)} AS t FROM documents), r AS (SELECT doc_id, unnest(regexp_extract_all(t, '(?i)(?:https?://|hf://|huggingface\\.co/)[^\\n]*')) AS s FROM d) SELECT doc_id, left(regexp_replace(s, '^[ \"'',]+|[ \"'',]+$', '', 'g'), 512) AS snippet FROM r")
def manifest_references(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.explode(companion.remote_snippets(F.concat("text", F.lit("\n"), one_of("doc_id", REFS)))).alias("snippet"))


MANIFESTS = ('{"artifact": "a.gguf", "sha256": "AB", "name": 1}', '{"artifact": "", "model": "m", "architecture": "llama"}', '{"artifact": null, "model": 0, "file": "f", "name": "n"}', '{"artifact": ["x"], "file": "f"}', '{"sha256": "x"}', "broken")


@query("manifest_declarations", f"""WITH d AS (SELECT doc_id, {one_of_sql('doc_id', MANIFESTS)} AS t FROM documents), j AS (SELECT doc_id, CAST(t AS JSON) AS v FROM d WHERE json_valid(t)),
r AS (SELECT doc_id, v, CASE WHEN CAST(v->'$.artifact' AS VARCHAR) NOT IN ('null', '""', '0', 'false', '[]', '{{}}') THEN v->'$.artifact' WHEN CAST(v->'$.model' AS VARCHAR) NOT IN ('null', '""', '0', 'false', '[]', '{{}}') THEN v->'$.model' ELSE v->'$.file' END AS a FROM j)
SELECT doc_id, a->>'$' AS artifact, CASE WHEN json_type(v->'$.sha256') = 'VARCHAR' THEN v->>'$.sha256' END AS sha256, CASE WHEN json_type(v->'$.architecture') = 'VARCHAR' THEN v->>'$.architecture' END AS architecture, CASE WHEN json_type(v->'$.name') = 'VARCHAR' THEN v->>'$.name' END AS name FROM r WHERE json_type(a) = 'VARCHAR'""")
def manifest_declarations(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", companion.declaration(one_of("doc_id", MANIFESTS)).alias("d")).where("d is not null").select("doc_id", "d.*")


KINDS = ("digest_mismatch", "name_match", "auto_map", "hardcoded_password", "adapter_present")


@query("companion_findings", f"""WITH e AS (SELECT source AS folder, doc_id AS seq, {one_of_sql('doc_id', KINDS)} AS kind, CASE WHEN doc_id % 3 = 0 THEN 'not_used' ELSE 'direct' END AS relevance, CASE WHEN doc_id % 4 = 0 THEN 'high' ELSE 'low' END AS severity FROM documents WHERE source <> (SELECT min(source) FROM documents)),
s AS (SELECT *, CASE WHEN ends_with(kind, '_mismatch') THEN 'suspicious' WHEN relevance = 'not_used' THEN 'not_applicable' WHEN ends_with(kind, '_match') THEN 'verified' WHEN severity = 'high' THEN 'suspicious' ELSE 'unchecked' END AS status FROM e)
SELECT folder, 'config.' || kind || '.' || CAST(seq AS VARCHAR) AS id, status, CASE WHEN status IN ('not_applicable', 'verified') THEN 'info' ELSE severity END AS severity, status = 'suspicious' AS mandatory FROM s UNION ALL SELECT min(source), 'config.no_signals', 'clean', 'info', false FROM documents""")
def companion_findings(spark, sf_dir):
    from assayer.operators import companions

    docs = read(spark, sf_dir, "documents")
    first = docs.agg(F.min("source")).first()[0]
    rows = docs.where(F.col("source") != first).select(F.col("source").alias("folder"), F.col("doc_id").alias("seq"), one_of("doc_id", KINDS).alias("kind"), F.when(F.col("doc_id") % 3 == 0, "not_used").otherwise("direct").alias("relevance"), F.when(F.col("doc_id") % 4 == 0, "high").otherwise("low").alias("severity"))
    return companions.findings(rows, docs.select(F.col("source").alias("folder")).distinct())


REPOS = ("https://malicious-models.com/x", "https://ok.example", "", None, "https://fake-huggingface.co/malicious-models.com")


@query("blocked_repositories", f"WITH d AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN {one_of_sql('doc_id', REPOS)} END AS a, {one_of_sql('(doc_id + 1)', REPOS)} AS b FROM documents), u AS (SELECT doc_id, coalesce(nullif(a, ''), nullif(b, '')) AS url FROM d) SELECT doc_id, h AS host FROM u, (VALUES ('malicious-models.com'), ('fake-huggingface.co')) t(h) WHERE contains(url, h)")
def blocked_repositories(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").withColumn("next", F.col("doc_id") + 1)
    pairs = F.create_map(F.lit(companion.REPOSITORY_KEYS[0]), F.when(F.col("doc_id") % 2 == 0, one_of("doc_id", REPOS)), F.lit(companion.REPOSITORY_KEYS[1]), one_of("next", REPOS))
    return docs.select("doc_id", F.explode(companion.blocked_host(pairs)).alias("host"))


# Runtimes.
GIVEN = ("b4321", " build: 77 ", "v1.2.3-rc1", "Commit ABCDEF12", "llama version 0.3.1", "nightly", "1234567", None, "build 5 (abcdef1)")
_GIVEN_SQL = lambda p: f"nullif(regexp_extract(t, {lit(p)}, 1), '')"


def _sql_identity(t: str) -> dict[str, str]:
    from assayer.functions import scalars

    group = lambda ps: "coalesce(" + ", ".join(f"nullif(regexp_extract({t}, {lit('(?im)' + p)}, 1), '')" for p in ps) + ")"
    return {"build": f"TRY_CAST({group(scalars.BUILD)} AS BIGINT)", "version": group(scalars.VERSION), "commit": f"lower({group(scalars.COMMIT)})"}


_SAID = _sql_identity("trim(t)")


@query("given_identities", f"""WITH g AS (SELECT s_suppkey, {one_of_sql('s_suppkey', GIVEN)} AS t FROM supplier), p AS (SELECT s_suppkey, t, {_GIVEN_SQL(runtimes.GIVEN_BUILD)} AS b, {_GIVEN_SQL(runtimes.GIVEN_VERSION)} AS v, {_GIVEN_SQL(runtimes.GIVEN_COMMIT)} AS c, {_SAID['build']} AS sb, {_SAID['version']} AS sv, {_SAID['commit']} AS sc FROM g)
SELECT s_suppkey, CASE WHEN b IS NOT NULL THEN CAST(b AS BIGINT) WHEN v IS NULL AND c IS NULL THEN sb END AS build, CASE WHEN b IS NOT NULL THEN NULL WHEN v IS NOT NULL THEN v WHEN c IS NOT NULL THEN NULL WHEN sb IS NOT NULL OR sv IS NOT NULL OR sc IS NOT NULL THEN sv ELSE trim(t) END AS version, CASE WHEN b IS NOT NULL OR v IS NOT NULL THEN NULL WHEN c IS NOT NULL THEN lower(c) ELSE sc END AS "commit" FROM p""")
def given_identities(spark, sf_dir):
    rows = read(spark, sf_dir, "supplier").select("s_suppkey", runtimes.given_identity(one_of("s_suppkey", GIVEN)).alias("i"))
    return rows.select("s_suppkey", F.col("i.build").alias("build"), F.col("i.version").alias("version"), F.col("i.commit").alias("commit"))


NEAR = (("build-info.json", '{"build": 4000, "commit": "ABCDEF1", "flags": ["--host", "0.0.0.0"]}'), ("build-info.json", '{"build": "x", "text": "version: 1.4"}'), ("version.txt", "llama build: 4100\nflags: --api-key  k"), ("build.txt", "no word"), ("build-info.json", "broken version: 2.5.1"))
_ORDER = {"given": 0, "nearby": 1, "git": 2, "binary": 3}
_NEAR_SQL = f"""src AS (SELECT s_suppkey, 1 AS rank, 0 AS place, {one_of_sql('s_suppkey', [n for n, _ in NEAR])} AS name, {one_of_sql('s_suppkey', [t for _, t in NEAR])} AS t FROM supplier WHERE s_suppkey % 7 <> 0
 UNION ALL SELECT s_suppkey, 2, 0, '.git', 'commit: {'b' * 40}' FROM supplier WHERE s_suppkey % 3 = 0 UNION ALL SELECT s_suppkey, 3, 1, '', 'llama.cpp version: 3.1' FROM supplier WHERE s_suppkey % 2 = 0)"""


@query("runtime_sources", f"""WITH {_NEAR_SQL}, j AS (SELECT *, CASE WHEN ends_with(name, '.json') AND json_valid(t) THEN CAST(t AS JSON) END AS v, {_SAID['build']} AS tb, {_SAID['version']} AS tv, {_SAID['commit']} AS tc FROM src),
k AS (SELECT *, json_type(v->'$.build') IN ('UBIGINT', 'BIGINT') AS jb, json_type(v->'$.version') = 'VARCHAR' AS jv, json_type(v->'$.commit') = 'VARCHAR' AS jc FROM j),
i AS (SELECT s_suppkey, rank, place, CASE WHEN coalesce(jb, false) OR coalesce(jv, false) OR coalesce(jc, false) THEN CASE WHEN jb THEN CAST(v->>'$.build' AS BIGINT) END ELSE tb END AS build, CASE WHEN coalesce(jb, false) OR coalesce(jv, false) OR coalesce(jc, false) THEN CASE WHEN jv THEN v->>'$.version' END ELSE tv END AS version, CASE WHEN coalesce(jb, false) OR coalesce(jv, false) OR coalesce(jc, false) THEN CASE WHEN jc THEN lower(v->>'$.commit') END ELSE tc END AS c,
 CASE WHEN json_type(v->'$.flags') = 'ARRAY' THEN CAST(v->'$.flags' AS VARCHAR[]) WHEN regexp_extract(t, '(?im)^\\s*flags?\\s*[:=]\\s*(.+?)\\s*$', 1) <> '' THEN string_split_regex(regexp_extract(t, '(?im)^\\s*flags?\\s*[:=]\\s*(.+?)\\s*$', 1), '\\s+') END AS flags FROM k),
b AS (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY rank, place) AS n FROM i WHERE build IS NOT NULL OR version IS NOT NULL OR c IS NOT NULL)
SELECT s.s_suppkey AS runtime, build, version, c AS "commit", CASE rank WHEN 1 THEN 'nearby_build_file' WHEN 2 THEN 'git_metadata' WHEN 3 THEN 'static_binary_strings' ELSE 'none' END AS method, CASE rank WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS confidence, rank IS NOT NULL AS identified, coalesce((SELECT array_to_string(any_value(flags), ' ') FROM i WHERE i.s_suppkey = s.s_suppkey AND rank = 1), '') AS flags FROM supplier s LEFT JOIN b ON b.s_suppkey = s.s_suppkey AND n = 1""")
def runtime_sources(spark, sf_dir):
    s, k = read(spark, sf_dir, "supplier"), F.col("s_suppkey")
    row = lambda when, source, place, name, text: s.where(when).select(k.alias("runtime"), F.lit(source).alias("source"), F.lit(place).alias("place"), name.alias("name"), text.alias("text"))
    sources = row(k % 7 != 0, "nearby", 0, one_of("s_suppkey", [n for n, _ in NEAR]), one_of("s_suppkey", [t for _, t in NEAR])).union(row(k % 3 == 0, "git", 0, F.lit(".git"), F.lit("commit: " + "b" * 40))).union(row(k % 2 == 0, "binary", 1, F.lit(""), F.lit("llama.cpp version: 3.1")))
    return runtimes.identify(s.select(k.alias("runtime")), sources).withColumn("flags", F.array_join("flags", " "))


PATHS = ("/opt/llama-server", "/opt/LLAMA-CLI.EXE", "/opt/other", "llama-run", "/x/llama-server.bak")


@query("runtime_posture", f"""WITH r AS (SELECT s_suppkey AS runtime, {one_of_sql('s_suppkey', PATHS)} AS path, s_suppkey % 512 AS mode, CASE WHEN s_suppkey % 13 = 0 THEN 'missing' END AS error, s_suppkey % 3 <> 0 AS identified FROM supplier),
c AS (SELECT *, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '(?i)\\.exe$', '') AS name FROM r), n AS (SELECT *, lower(name) IN ({listed(runtimes.RUNTIME_NAMES)}) AS recognized FROM c)
SELECT runtime, 'runtime.inspection_error' AS id, 'runtime_identity' AS "check", 'error' AS status, 'info' AS severity, true AS mandatory FROM n WHERE error IS NOT NULL UNION ALL SELECT runtime, 'runtime.not_recognized', 'runtime_identity', 'unchecked', 'info', true FROM n WHERE error IS NULL AND NOT recognized
 UNION ALL SELECT runtime, 'runtime.unknown_build', 'runtime_identity', 'unchecked', 'info', true FROM n WHERE error IS NULL AND NOT identified UNION ALL SELECT runtime, 'runtime.writable_by_others', 'runtime_permissions', 'suspicious', 'medium', true FROM n WHERE error IS NULL AND mode & 2 <> 0""")
def runtime_posture(spark, sf_dir):
    k = F.col("s_suppkey")
    rows = read(spark, sf_dir, "supplier").select(k.alias("runtime"), (k % 512).cast("int").alias("mode"), F.when(k % 13 == 0, "missing").alias("error"), (k % 3 != 0).alias("identified"), (runtimes.runtime_component(one_of("s_suppkey", PATHS)) != "unknown").alias("recognized"))
    return runtimes.posture(rows)


# Knowledge.
@query("interval_overlaps", """WITH t AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN NULL ELSE l_partkey % 50 END AS gt, CASE l_linenumber % 3 WHEN 0 THEN l_partkey % 40 END AS gte, CASE WHEN l_linenumber % 2 = 0 THEN l_suppkey % 60 END AS lt, CASE WHEN l_linenumber % 5 = 0 THEN NULL ELSE l_suppkey % 30 END AS lte FROM lineitem),
e AS (SELECT *, coalesce(gt + 1, gte, 0) AS p, lt - 1 AS q, lte AS s FROM t) SELECT l_orderkey, l_linenumber, coalesce(greatest(p, 0) <= least(q, s), true) AS meet FROM e""")
def interval_overlaps(spark, sf_dir):
    n, part, supp = F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")
    a = F.map_filter(F.create_map(F.lit("gt"), F.when(n % 3 != 0, part % 50), F.lit("gte"), F.when(n % 3 == 0, part % 40), F.lit("lt"), F.when(n % 2 == 0, supp % 60)), lambda k, v: v.isNotNull())
    b = F.map_filter(F.create_map(F.lit("lte"), F.when(n % 5 != 0, supp % 30)), lambda k, v: v.isNotNull())
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", knowledge.intervals_overlap(a, b).alias("meet"))


PREDICATES = ((("format", "present", None), ("format", "equals", '"gguf"')), (("architecture.x", "equals", '"en"'),), (("has_chat_template", "equals", "true"),), (("license", "present", None),), (("license", "equals", "null"),), (("name", "matches", None),))


@query("predicates", """WITH d AS (SELECT doc_id, lang, doc_id % 2 = 0 AS t, CASE WHEN doc_id % 5 = 0 THEN 'mit' END AS license FROM documents) SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN true WHEN 1 THEN lang = 'en' WHEN 2 THEN t WHEN 3 THEN license IS NOT NULL WHEN 4 THEN license IS NULL ELSE false END AS holds FROM d""")
def predicates(spark, sf_dir):
    rows = F.array(*(F.array(*(F.struct(F.lit(a).alias("field"), F.lit(o).alias("operator"), F.lit(v).cast("string").alias("value")) for a, o, v in ps)) for ps in PREDICATES))
    text = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    facts = {"format": F.lit('"gguf"'), "architecture": text(F.col("lang")), "name": F.lit('"x"'), "has_chat_template": (F.col("doc_id") % 2 == 0).cast("string"), "file_type": F.lit("1")}
    metadata = F.map_filter(F.create_map(F.lit("license"), F.when(F.col("doc_id") % 5 == 0, F.lit('"mit"'))), lambda k, v: v.isNotNull())
    return read(spark, sf_dir, "documents").select("doc_id", knowledge.predicates_hold(F.element_at(rows, (F.col("doc_id") % 6 + 1).cast("int")), facts, metadata).alias("holds"))


@query("advisory_lists", "WITH t AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events) SELECT user_id, count(*) AS rows, count(DISTINCT event_type) AS distinct_ids, count(*) FILTER (WHERE p >= event_type) AS out_of_order FROM t GROUP BY user_id")
def advisory_lists(spark, sf_dir):
    return knowledge.list_faults(read(spark, sf_dir, "events"), ["user_id"], "event_type", "event_id")


@query("bundle_ages", "SELECT o_orderkey, CASE WHEN datediff('day', DATE '1996-01-01', CAST(o_orderdate AS DATE)) <= 0 THEN 'expired' WHEN datediff('day', DATE '1996-01-01', CAST(o_orderdate AS DATE)) < 30 THEN 'soon' ELSE 'valid' END AS age FROM orders")
def bundle_ages(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", knowledge.days_left(F.col("o_orderdate").cast("date"), F.to_date(F.lit("1996-01-01"))).alias("age"))


# Digests.
@query("digest_findings", """WITH d AS (SELECT doc_id, sha256(text) AS digest, CASE doc_id % 3 WHEN 0 THEN NULL WHEN 1 THEN upper(sha256(text)) ELSE sha256(text || 'x') END AS e FROM documents WHERE text IS NOT NULL),
k AS (SELECT doc_id, CASE WHEN e IS NULL THEN 'digest_absent' WHEN lower(e) = digest THEN 'digest_match' ELSE 'digest_mismatch' END AS k FROM d) SELECT doc_id, 'identity.' || k AS id, CASE k WHEN 'digest_absent' THEN 'unchecked' WHEN 'digest_match' THEN 'verified' ELSE 'suspicious' END AS status, CASE k WHEN 'digest_mismatch' THEN 'high' ELSE 'info' END AS severity, k <> 'digest_absent' AS mandatory FROM k""")
def digest_findings(spark, sf_dir):
    m = F.col("doc_id") % 3
    rows = read(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("digest"), F.when(m == 1, F.upper(F.sha2("text", 256))).when(m == 2, F.sha2(F.concat("text", F.lit("x")), 256)).alias("expected"))
    return digests.digest_findings(rows, ["doc_id"])


@query("first_artifacts", "WITH t AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) SELECT source, doc_id FROM t WHERE n = 1")
def first_artifacts(spark, sf_dir):
    return structure.first_of(read(spark, sf_dir, "documents"), ["source"], ["doc_id"]).select("source", "doc_id")


# Templates.
ARCHITECTURES = ("qwen2", "Qwen3MoE", None, "llama", "gemma", "gemma3", "x", "mistral", "deepseek2")
MODELS = ("Qwen2.5-7B", "meta-LLAMA-3", "gemma-2-9b", None, "DeepSeek", "y", "Mistral-7B")
_CASE = lambda c, pairs: " ".join(f"WHEN contains(lower({c}), '{w}') THEN '{k}'" for w, k in pairs)
_FAMILY = "CASE WHEN contains(lower(a), 'qwen') THEN CASE WHEN contains(a, '3') THEN 'qwen3-instruct' ELSE 'qwen25-instruct' END WHEN contains(lower(a), 'llama') THEN 'llama3-instruct' WHEN contains(lower(a), 'gemma') THEN CASE WHEN contains(a, '3') THEN 'gemma3-instruct' ELSE 'gemma2-instruct' END WHEN contains(lower(a), 'mistral') THEN 'mistral-instruct' WHEN contains(lower(a), 'deepseek') THEN 'deepseek-v3' " + _CASE("n", templates.BY_NAME) + " END"


@query("template_families", f"WITH d AS (SELECT doc_id, {one_of_sql('doc_id', ARCHITECTURES)} AS a, {one_of_sql('doc_id', MODELS)} AS n FROM documents), f AS (SELECT doc_id, {_FAMILY} AS family FROM d) SELECT doc_id, f.family, r.revision FROM f LEFT JOIN (VALUES ('qwen3-instruct', 'r1'), ('llama3-instruct', 'r2')) r(family, revision) ON f.family = r.family")
def template_families(spark, sf_dir):
    known = spark.createDataFrame([("qwen3-instruct", "r1"), ("llama3-instruct", "r2")], "family string, revision string")
    docs = read(spark, sf_dir, "documents").select("doc_id", templates.family(one_of("doc_id", ARCHITECTURES), one_of("doc_id", MODELS)).alias("family"))
    return docs.join(F.broadcast(known), "family", "left").select("doc_id", "family", "revision")


_SPACES = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
ODD_SPACES = ("\u00a0x\u2003 \u3000", " \x85\u2028y\u1680", "\x1cz\x1f", "\u202f\u205f\u200a", "")


@query("plain_space", f"SELECT doc_id, md5(regexp_replace(regexp_replace({one_of_sql('doc_id', ODD_SPACES)} || text, '{_SPACES}', ' ', 'g'), '^ | $', '', 'g')) AS digest FROM documents WHERE text IS NOT NULL")
def plain_space(spark, sf_dir):
    """Every text, most behind white space of other scripts."""
    return read(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.md5(templates.plain_space(F.concat(one_of("doc_id", ODD_SPACES), "text"))).alias("digest"))


EVIDENCE = ("call", "macro", "dangerous_function", "poison_dangerous_function", "exfiltration_url", "call")
_EVIDENCE_SQL = f"e AS (SELECT user_id, event_id AS seq, {one_of_sql('event_id', EVIDENCE)} AS kind FROM events)"


def _evidence(spark, sf_dir):
    return read(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("seq"), one_of("event_id", EVIDENCE).alias("kind"))


@query("construct_counts", f"WITH {_EVIDENCE_SQL}, c AS (SELECT user_id, kind, count(*) AS n FROM e GROUP BY user_id, kind) SELECT user_id, CAST(sum(n) AS BIGINT) AS constructs, string_agg(CASE WHEN n > 1 THEN kind || '×' || CAST(n AS VARCHAR) ELSE kind END, ', ' ORDER BY kind) AS kinds FROM c GROUP BY user_id")
def construct_counts(spark, sf_dir):
    return template_findings.construct_counts(_evidence(spark, sf_dir), ["user_id"])


_SECURITY = f"{_EVIDENCE_SQL}, b AS (SELECT *, regexp_replace(kind, '^poison_', '') AS base, starts_with(kind, 'poison_') AS p FROM e), n AS (SELECT *, row_number() OVER (PARTITION BY user_id, base ORDER BY seq) - 1 AS i, base IN ('dangerous_function', 'exfiltration_url') AS high FROM b), f AS (SELECT user_id, 'template.' || CASE WHEN p THEN 'poison' ELSE 'security' END || '.' || base || '.' || CAST(i AS VARCHAR) AS id, CASE WHEN p THEN 'template_poison_detection' ELSE 'template_enhanced_security' END AS \"check\", CASE WHEN high THEN 'suspicious' ELSE 'unchecked' END AS status, CASE WHEN high THEN 'high' ELSE 'low' END AS severity, CASE WHEN high THEN 'high' ELSE 'medium' END AS classification, high AS mandatory FROM n)"


@query("template_security", f"WITH {_SECURITY} SELECT * FROM f")
def template_security(spark, sf_dir):
    return template_findings.security_findings(_evidence(spark, sf_dir), ["user_id"])


@query("template_verdicts", f"WITH {_SECURITY} SELECT user_id, CASE WHEN bool_or(status = 'suspicious') THEN 'not_suitable' WHEN bool_or(status NOT IN ('verified', 'clean', 'not_applicable') AND severity IN ('high', 'critical')) THEN 'undetermined' ELSE 'clean' END AS verdict FROM f GROUP BY user_id")
def template_verdicts(spark, sf_dir):
    return template_findings.template_verdicts(template_security(spark, sf_dir), ["user_id"])


CANDIDATES = ("{% if a %}x  y{% endif %}", "{% if a %} x y {% endif %}", "{% if b %}x y{% endif %}", "{% if", "{{ m }}")


@query("template_comparisons", f"SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'not_applicable' ELSE {one_of_sql('doc_id', ('identical', 'cosmetic', 'different', 'error', 'different'))} END AS classification, CASE WHEN doc_id % 7 = 0 THEN 'not_applicable' ELSE {one_of_sql('doc_id', ('verified', 'clean', 'unchecked', 'error', 'unchecked'))} END AS status FROM documents")
def template_comparisons(spark, sf_dir):
    known = spark.createDataFrame([("f", "v", "1", CANDIDATES[0])], "family string, variant string, revision string, template string")
    docs = read(spark, sf_dir, "documents").select("doc_id", F.lit("f").alias("family"), F.lit("v").alias("variant"), F.when(F.col("doc_id") % 7 == 0, "2").otherwise("1").alias("revision"), one_of("doc_id", CANDIDATES).alias("template"))
    compared = template_findings.compare_references(docs, known)
    return template_findings.comparison_findings(compared, ["doc_id", "classification"]).select("doc_id", "classification", "status")


# Scanners.
SCANNED = ("a.pkl: Dangerous import 'os system' FOUND\nok\nb.bin: suspicious import 'x y' FOUND  ", "clean", "A.PKL: dangerous import 'os system' FOUND", "x: dangerous import '' FOUND")
_LINES = f"l AS (SELECT doc_id, i - 1 AS n, string_split(t, chr(10))[i] AS line FROM (SELECT doc_id, {one_of_sql('doc_id', SCANNED)} AS t FROM documents) d, range(1, 4) r(i) WHERE i <= len(string_split(t, chr(10)))), p AS (SELECT doc_id, n, lower(regexp_extract(line, {lit('(?i)' + scanners.IMPORT_LINE)}, 2)) AS kind, regexp_extract(line, {lit('(?i)' + scanners.IMPORT_LINE)}, 3) AS imported, regexp_extract(line, {lit('(?i)' + scanners.IMPORT_LINE)}, 1) AS location FROM l WHERE regexp_matches(line, {lit('(?i)' + scanners.IMPORT_LINE)}))"


@query("scanner_lines", f"WITH {_LINES} SELECT doc_id, 'line-' || CAST(n AS VARCHAR) AS external, CASE kind WHEN 'dangerous' THEN 'critical' ELSE 'medium' END AS severity, kind || ': ' || imported AS message, location FROM p")
def scanner_lines(spark, sf_dir):
    return scanners.import_lines(read(spark, sf_dir, "documents").select("doc_id", one_of("doc_id", SCANNED).alias("t")), "t").drop("n")


@query("scanner_findings", """WITH r AS (SELECT user_id AS target, CASE event_id % 2 WHEN 0 THEN 'modelscan' ELSE 'picklescan' END AS tool, event_id AS n, CASE event_id % 5 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'medium' ELSE 'Critical' END AS severity, 'Bad ' || event_type AS message FROM events),
w AS (SELECT *, CASE WHEN lower(severity) IN ('high', 'critical') THEN lower(severity) ELSE 'info' END AS weight, lower(severity) IN ('high', 'critical') AS high FROM r), k AS (SELECT *, row_number() OVER (PARTITION BY target, weight, lower(message) ORDER BY tool, n) AS i FROM w)
SELECT target, 'delegate.' || tool || '.' || regexp_replace(lower(message), '[^a-z0-9_.-]+', '-', 'g') || '.' || CAST(n AS VARCHAR) AS id, 'delegate_' || tool AS "check", CASE WHEN high THEN 'suspicious' ELSE 'unchecked' END AS status, weight AS severity, 'medium' AS classification, high AS mandatory, message AS summary FROM k WHERE i = 1""")
def scanner_findings(spark, sf_dir):
    e, none = F.col("event_id"), F.lit(None).cast("string")
    rows = read(spark, sf_dir, "events").select(F.col("user_id").alias("target"), F.when(e % 2 == 0, "modelscan").otherwise("picklescan").alias("tool"), e.alias("n"), F.lit("finding").alias("outcome"), F.concat(F.lit("Bad "), "event_type").alias("external"), F.when(e % 5 == 0, "HIGH").when(e % 5 == 1, "medium").otherwise("Critical").alias("severity"), F.concat(F.lit("Bad "), "event_type").alias("message"), none.alias("location"), none.alias("error"))
    return scanners.findings(rows)


TOOLS, SUFFIXES = ("modelaudit", "picklescan", "fickling", "modelscan"), (".bin", ".onnx", ".gguf", "", ".PT")


@query("scanner_targets", f"WITH t AS (SELECT doc_id, {one_of_sql('doc_id', TOOLS)} AS tool, lower({one_of_sql('doc_id', SUFFIXES)}) AS s FROM documents) SELECT doc_id, tool = 'modelaudit' OR s = '' OR (tool IN ('picklescan', 'fickling') AND s IN ({listed(scanners.PICKLES)})) OR (tool = 'modelscan' AND s IN ({listed(scanners.MODELS)})) AS taken FROM t")
def scanner_targets(spark, sf_dir):
    s = F.lower(one_of("doc_id", SUFFIXES))
    return read(spark, sf_dir, "documents").select("doc_id", scanners.supported(one_of("doc_id", TOOLS), s, s == "").alias("taken"))


# Reports.
_REPORT_SQL = "f AS (SELECT o_custkey AS run, o_orderkey AS seq, 'f.' || CAST(o_orderkey % 97 AS VARCHAR) AS id, CASE o_orderstatus WHEN 'F' THEN 'suspicious' WHEN 'O' THEN 'error' ELSE 'clean' END AS status, CASE o_orderkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS severity, o_orderpriority AS path, 'note ' || CAST(o_custkey AS VARCHAR) AS summary FROM orders)"


def _report(spark, sf_dir):
    o = F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "F", "suspicious").when(F.col("o_orderstatus") == "O", "error").otherwise("clean")
    weight = o % 3
    return read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run"), o.alias("seq"), F.concat(F.lit("f."), (o % 97).cast("string")).alias("id"), status.alias("status"), F.when(weight == 0, "high").when(weight == 1, "medium").otherwise("low").alias("severity"), F.col("o_orderpriority").alias("path"), F.concat(F.lit("note "), F.col("o_custkey").cast("string")).alias("summary"))


_LEVEL_SQL = "CASE severity WHEN 'high' THEN 'error' WHEN 'medium' THEN 'warning' ELSE 'note' END"


@query("sarif_results", f"WITH {_REPORT_SQL}, r AS (SELECT id, min(seq) AS s FROM f GROUP BY id), n AS (SELECT id, CAST(row_number() OVER (ORDER BY s) - 1 AS INTEGER) AS rule_index FROM r) SELECT f.id AS rule_id, rule_index, {_LEVEL_SQL} AS level, summary AS message, CASE WHEN path IN ('1-URGENT', '2-HIGH') THEN path ELSE '2-HIGH' END AS uri FROM f JOIN n ON n.id = f.id WHERE status IN ('suspicious', 'error')")
def sarif_results(spark, sf_dir):
    return reports.sarif_results(_report(spark, sf_dir), spark.createDataFrame([(1, "1-URGENT"), (0, "2-HIGH")], "seq int, path string"))


@query("explained", f"WITH {_REPORT_SQL} SELECT run, seq, status FROM f WHERE id = 'f.5' ORDER BY seq LIMIT 1")
def explained(spark, sf_dir):
    return reports.explain(_report(spark, sf_dir), "f.5").select("run", "seq", "status")


@query("error_places", f"WITH {_REPORT_SQL} SELECT run, path, string_agg(id, ',' ORDER BY seq) AS errors FROM f WHERE status = 'error' GROUP BY run, path")
def error_places(spark, sf_dir):
    return reports.errors_by_place(_report(spark, sf_dir), ["run"], "path").withColumn("errors", F.array_join("errors", ","))


@query("report_counts", f"WITH {_REPORT_SQL} SELECT run, count(*) FILTER (WHERE status = 'suspicious') AS suspicious, count(*) FILTER (WHERE status = 'error') AS errors FROM f GROUP BY run")
def report_counts(spark, sf_dir):
    return reports.status_counts(_report(spark, sf_dir), ["run"])


NEEDS = ("runtime_config.bind_all_interfaces", "template.security.call.0", "join.CVE-1", "config.no_signals", "x.api_key")


@query("report_needs", f"WITH f AS (SELECT o_custkey AS run, {one_of_sql('o_orderkey', NEEDS)} AS id FROM orders) SELECT run, bool_or(contains(id, 'bind_all_interfaces') OR contains(id, 'api_key')) AS network, bool_or(contains(id, 'template.') OR contains(id, 'CVE') OR contains(id, 'GHSA')) AS sandbox FROM f GROUP BY run")
def report_needs(spark, sf_dir):
    return reports.needs(read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run"), one_of("o_orderkey", NEEDS).alias("id")), ["run"])


@query("report_summaries", f"WITH {_REPORT_SQL}, a AS (SELECT run, count(*) FILTER (WHERE status = 'suspicious') AS n, arg_min(id, seq) FILTER (WHERE status = 'suspicious') AS i, arg_min(summary, seq) FILTER (WHERE status = 'suspicious') AS s FROM f GROUP BY run) SELECT run, 'clean' AS verdict, CASE WHEN n > 0 THEN 'Verdict: clean. ' || CAST(n AS VARCHAR) || ' suspicious finding(s). First: ' || i || ' — ' || s ELSE 'Verdict: clean. No suspicious findings.' END AS summary FROM a")
def report_summaries(spark, sf_dir):
    found = _report(spark, sf_dir)
    return reports.summaries(found, found.select("run").distinct().withColumn("verdict", F.lit("clean")), ["run"])


@query("report_texts", "SELECT o_orderkey, regexp_replace('[' || o_orderpriority || ']*' || o_orderstatus, '([\\\\`*_\\[\\]<>|])', '\\\\\\1', 'g') AS escaped, left(o_orderpriority, 7) AS preview FROM orders")
def report_texts(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", reports.markdown_escape(F.concat(F.lit("["), "o_orderpriority", F.lit("]*"), "o_orderstatus")).alias("escaped"), reports.previews(F.col("o_orderpriority"), 7).alias("preview"))


_CORE = (*verdict.CORE, verdict.RUNTIME_CHECK)


@query("core_gaps", f"WITH {_findings_sql}, g AS (SELECT source, doc_id, list(DISTINCT \"check\") AS c, coalesce(list(DISTINCT \"check\") FILTER (WHERE status IN ('verified', 'clean', 'not_applicable')), []) AS p FROM findings GROUP BY source, doc_id) SELECT doc_id, array_to_string(list_sort(list_filter([{listed(_CORE)}], lambda x: NOT list_contains(c, x))), ',') AS missing, array_to_string(list_sort(list_filter([{listed(_CORE)}], lambda x: list_contains(c, x) AND NOT list_contains(p, x))), ',') AS gaps FROM g")
def core_gaps(spark, sf_dir):
    rows = reports.missing_core(document_findings(spark, sf_dir), ["source", "doc_id"], _CORE)
    return rows.select("doc_id", F.array_join("missing", ",").alias("missing"), F.array_join("gaps", ",").alias("gaps"))


ADVICE = ("join.CVE-1", "runtime.unknown", "config.api_key.0", "template.security.x", "prompt.extraction", "config.pickle.1", "config.credential", "config.trust_remote_code", "supply_chain.x", "model.uncensored")


@query("all_recommendations", f"""WITH f AS (SELECT o_custkey AS run, {one_of_sql('o_orderkey', ADVICE)} AS id, CASE o_orderkey % 3 WHEN 0 THEN 'suspicious' ELSE 'unchecked' END AS status FROM orders),
h(category, priority, title, words, wanted) AS (VALUES ('runtime', 'critical', 'Update the runtime', ['CVE'], 'suspicious'), ('runtime', 'medium', 'Find out the runtime''s version', ['runtime'], 'unchecked'), ('network', 'high', 'Keep keys out of arguments', ['api_key'], NULL), ('template', 'critical', 'Don''t load the chat template', ['template'], 'suspicious'), ('template', 'medium', 'Limit prompt extraction', ['extraction'], NULL),
 ('companion', 'critical', 'Drop pickled files', ['pickle'], 'suspicious'), ('companion', 'critical', 'Rotate exposed credentials', ['credential', 'api_key'], NULL), ('companion', 'high', 'Turn remote code off', ['trust_remote'], NULL), ('supply_chain', 'high', 'Check where the model comes from', ['supply_chain'], 'suspicious'), ('supply_chain', 'medium', 'Review an altered model', ['uncensored'], NULL), ('general', 'low', 'Verify digests', [''], NULL), ('general', 'low', 'Run with least rights', [''], NULL), ('general', 'medium', 'Keep models isolated', [''], NULL))
SELECT DISTINCT run, category, priority, title FROM f, h WHERE len(list_filter(words, lambda w: contains(id, w))) > 0 AND (wanted IS NULL OR status = wanted)""")
def all_recommendations(spark, sf_dir):
    o = F.col("o_orderkey")
    rows = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run"), one_of("o_orderkey", ADVICE).alias("id"), F.when(o % 3 == 0, "suspicious").otherwise("unchecked").alias("status"))
    return verdict.recommendations(rows, ["run"])


