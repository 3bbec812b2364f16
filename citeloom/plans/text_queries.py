"""Text and citation queries over documents and opinions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom import constants as K
from citeloom.functions import citations as C
from citeloom.functions import text as X
from citeloom.plans import views as V
from citeloom.session import table

_P = C.reporter_pattern(V.REPORTERS)


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "text")


def opinions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "cases_enriched").select("row_id", "plain_text")


def extract_citations(spark, sf):
    return C.extract(docs(spark, sf), "doc_id", "text", V.REPORTERS)


_EXTRACT = f"""
found AS (SELECT doc_id, unnest(regexp_extract_all(text, {_q(_P)})) AS m, generate_subscripts(regexp_extract_all(text, {_q(_P)}), 1) AS place FROM documents),
parts AS (SELECT doc_id, place, CAST(regexp_extract(m, {_q(_P)}, 1) AS INTEGER) AS volume, regexp_extract(m, {_q(_P)}, 2) AS reporter, CAST(regexp_extract(m, {_q(_P)}, 3) AS INTEGER) AS page FROM found),
cites AS (SELECT doc_id, CAST(min(place) AS INTEGER) AS pos, volume, reporter, page, volume || ' ' || reporter || ' ' || page AS citation_string FROM parts GROUP BY doc_id, volume, reporter, page)"""


def citation_context(spark, sf):
    d = docs(spark, sf).withColumn("s", X.sentences(F.col("text")))
    j = extract_citations(spark, sf).join(d, "doc_id")
    return j.select("doc_id", "pos", "citation_string", C.sentence_context(F.col("s"), F.col("citation_string")).alias("context"))


def char_window(spark, sf):
    j = extract_citations(spark, sf).join(docs(spark, sf), "doc_id")
    return j.select("doc_id", "pos", C.char_context(F.col("text"), F.col("citation_string")).alias("window_text"))


def _names(spark, sf):
    return table(spark, sf, "name_checks").select("check_id", "cited_name")


def party_names(spark, sf):
    return _names(spark, sf).select("check_id", C.party_names(F.col("cited_name")).alias("parties"))


def cited_year(spark, sf):
    b = table(spark, sf, "benchmark_items")
    return b.select("benchmark_id", C.cited_year(F.col("citation")).alias("cited_year_found"))


_ALIAS = "CASE " + " ".join(f"WHEN contains(lower(citation), {_q(a)}) THEN {_q(c)}" for c, names in K.COURT_ALIASES.items() for a in names) + " END"
_COURT = f"coalesce(nullif(regexp_extract(trim(lower(citation)), {_q(C.COURT)}, 1), ''), {_ALIAS})"
_LABEL = "CASE lower({c}) " + " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in K.CIRCUIT_LABELS.items()) + " ELSE 'State/Other' END"


def opinion_id(spark, sf):
    t = table(spark, sf, "cases_enriched")
    return t.select("row_id", C.opinion_id(F.col("opinions_cited")).alias("first_opinion"))


def parse_list(spark, sf):
    t = table(spark, sf, "cases_enriched")
    return t.select("row_id", F.size(C.json_list(F.col("citations"), False)).alias("n_items"), F.get(C.json_list(F.col("citations"), True), F.lit(0)).alias("first_item"))


def sentence_split(spark, sf):
    s = docs(spark, sf).withColumn("s", X.sentences(F.col("text")))
    return s.select("doc_id", F.posexplode("s").alias("at", "sentence")).select("doc_id", (F.col("at") + 1).alias("pos"), "sentence")


def _over(name, col):
    def q(spark, sf):
        return opinions(spark, sf).select("row_id", col(F.col("plain_text")).alias("out_text"))

    q.__name__ = name
    return q


strip_headers = _over("strip_headers", X.strip_headers)
normalize_citations = _over("normalize_citations", X.normalize_citations)
normalize_ws = _over("normalize_ws", X.normalize_space)
fix_encoding = _over("fix_encoding", X.fix_encoding)
clean_opinions = _over("clean_opinions", X.clean)


def _sql_headers(c: str) -> str:
    for p in X.HEADER_PATTERNS:
        flags = p[2 : p.index(")")].replace("d", "")
        c = f"regexp_replace({c}, {_q('(?' + flags + ')' + p[p.index(')') + 1 :])}, '', 'g')"
    return c


def _sql_cites(c: str) -> str:
    c = f"regexp_replace(regexp_replace({c}, {_q(X.CASE_NAME)}, '[CITATION]', 'g'), {_q(X.REPORTER)}, '[CITATION]', 'g')"
    return rf"regexp_replace({c}, '(?:\[CITATION\][ \t\n\r\f]*){{2,}}', '[CITATION] ', 'g')"


def _sql_space(c: str) -> str:
    return rf"regexp_replace(regexp_replace(regexp_replace({c}, '\n{{3,}}', chr(10) || chr(10), 'g'), '(?m)[ \t\r\f]+$', '', 'g'), '^[ \t\n\r\f]+|[ \t\n\r\f]+$', '', 'g')"


def _sql_encoding(c: str) -> str:
    pairs = "".join(f"replace(" for _ in X.REPLACED)
    return pairs + f"nfc_normalize({c})" + "".join(f", chr({ord(a)}), {_q(b)})" for a, b in X.REPLACED.items())


def strip_html(spark, sf):
    html = F.concat(F.lit("<p class='x'>"), F.replace(F.col("text"), F.lit("\n"), F.lit("<br/>&nbsp;&#160;")), F.lit("</p>"))
    return docs(spark, sf).select("doc_id", X.strip_html(html).alias("plain"))


def _tokens(name, fn):
    def q(spark, sf):
        d = docs(spark, sf).select("doc_id", fn(F.col("text")).alias("t"))
        return d.select("doc_id", F.size("t").alias("n_tokens"), X.text_hash(F.array_join("t", " ")).alias("tokens_hash"))

    q.__name__ = name
    return q


tokenize_corpus, tokenize_query, tokenize_landmark = _tokens("tokenize_corpus", X.corpus_tokens), _tokens("tokenize_query", X.query_tokens), _tokens("tokenize_landmark", X.landmark_tokens)
_IN = lambda ws: "(" + ", ".join(_q(w) for w in ws) + ")"


def _sql_tokens(expr: str) -> str:
    return f"WITH t AS (SELECT doc_id, {expr} AS t FROM documents) SELECT doc_id, CAST(len(t) AS INTEGER) AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_hash FROM t"


_CORPUS = f"list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda x: x IN {_IN(K.PRESERVED)} OR (x NOT IN {_IN(K.STOP_WORDS)} AND length(x) >= 2))"
_QUERY = f"list_filter(regexp_extract_all(lower(substr(text, 1, 5000)), '[a-z]+'), lambda x: (x IN {_IN(K.PRESERVED)} OR x NOT IN {_IN(K.STOP_WORDS)}) AND length(x) > 1)"
TOKENS_SQL = _WORDS = r"list_filter(regexp_split_to_array({c}, '[ \t\n\r\f]+'), lambda x: x <> '')"


def classify_doctrines(spark, sf):
    d = V.cases(spark, sf, "plain_text").select("case_id", X.doctrines(F.col("plain_text")).alias("ids"))
    return d.filter(F.size("ids") > 0).select("case_id", F.array_join("ids", ",").alias("doctrine_ids"))


_HEAD = f"array_to_string(list_slice({_WORDS.format(c='lower(plain_text)')}, 1, 3000), ' ')"
_DOCTRINE_LIST = "concat_ws(',', " + ", ".join(f"CASE WHEN {' OR '.join(f'contains(h, {_q(k)})' for k in keys)} THEN {_q(n)} END" for n, keys in K.DOCTRINES.items()) + ")"
DOCTRINES_SQL = f"heads AS (SELECT case_id, {_HEAD} AS h FROM cases WHERE plain_text IS NOT NULL), tagged AS (SELECT case_id, {_DOCTRINE_LIST} AS doctrine_ids FROM heads), doctrines AS (SELECT * FROM tagged WHERE doctrine_ids <> '')"


def doctrine_edges(spark: SparkSession, sf: str) -> DataFrame:
    d = V.cases(spark, sf, "plain_text").filter("plain_text is not null").select("case_id", F.explode(X.doctrines(F.col("plain_text"))).alias("doctrine"))
    return d


def doctrine_dim(spark, sf):
    d = doctrine_edges(spark, sf).groupBy(F.col("doctrine").alias("id")).agg(F.count("*").alias("n_cases"))
    return d.select("id", X.display_name(F.col("id")).alias("name"), "n_cases")


def paragraphs(spark, sf):
    d = opinions(spark, sf).select("row_id", F.posexplode(X.paragraphs(F.col("plain_text"))).alias("at", "paragraph"))
    return d.select("row_id", (F.col("at") + 1).alias("pos"), "paragraph")


def chunk_paragraphs(spark, sf):
    d = opinions(spark, sf).filter("plain_text is not null").select("row_id", F.posexplode(X.packed_chunks(X.paragraphs(F.col("plain_text")))).alias("chunk_index", "chunk"))
    return d.select("row_id", "chunk_index", "chunk")


def truncate_words(spark, sf):
    return opinions(spark, sf).select("row_id", X.first_words(F.col("plain_text"), 2000).alias("excerpt"))


def prune_kept(spark, sf):
    t = opinions(spark, sf).filter(F.length("plain_text") >= K.MIN_CHARS)
    return t.select("row_id", F.substring("plain_text", 1, K.MAX_CHARS).alias("plain_text"))


def prune_dropped(spark, sf):
    return opinions(spark, sf).filter(F.col("plain_text").isNull() | (F.length("plain_text") < K.MIN_CHARS)).select("row_id", F.length("plain_text").alias("n_chars"))


def text_presence(spark, sf):
    has_text, has_cites = F.length(F.trim("plain_text")) > 0, F.length(F.trim("citations")) > 0
    kind = F.when(has_text & has_cites, "both").when(has_text, "plain").when(has_cites, "citations").otherwise("neither")
    return table(spark, sf, "cases_enriched").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def year_from_date(spark, sf):
    return table(spark, sf, "cases_enriched").select("row_id", X.year_of(F.col("date_filed")).alias("year"))


def md5_dedup(spark, sf):
    d = docs(spark, sf).filter("text is not null").select("doc_id", X.text_hash(F.col("text")).alias("h"))
    return d.groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


def word_token_estimate(spark, sf):
    return opinions(spark, sf).filter("plain_text is not null").select("row_id", F.size(X.words(F.col("plain_text"))).alias("n_words"), X.estimated_tokens(F.col("plain_text")).alias("n_tokens"))


def search_links(spark, sf):
    return _names(spark, sf).filter("cited_name is not null").select("check_id", X.label(F.col("cited_name"), 40).alias("short_name"), F.url_encode("cited_name").alias("q"))


def prompts(spark, sf):
    b = table(spark, sf, "benchmark_items")
    p = F.concat(F.lit("Citation: "), F.coalesce("citation", F.lit("unknown")), F.lit("\nProposition: "), F.coalesce("context", F.lit("")))
    return b.select("benchmark_id", p.alias("prompt"))


def fenced_replies(spark, sf):
    reply = F.concat(F.lit('```json\n{"accurate": '), F.when(F.col("label") == "REAL", "true").otherwise("false"), F.lit("}\n```"))
    # Fenced, bare and broken replies in turn; what is no JSON gives null.
    reply = F.when(F.col("benchmark_id") % 3 == 0, F.regexp_replace(reply, "```(json)?", "")).when(F.col("benchmark_id") % 7 == 0, F.lit("I think it is accurate.")).otherwise(reply)
    r = table(spark, sf, "benchmark_items").select("benchmark_id", F.from_json(X.fenced_json(reply), "accurate boolean").alias("r"))
    return r.select("benchmark_id", F.col("r.accurate").alias("accurate"))


_NAMES = [
    "extract_citations", "citation_context", "char_window", "party_names", "cited_year", "opinion_id", "parse_list", "sentence_split", "strip_headers", "normalize_citations", "normalize_ws", "fix_encoding", "clean_opinions", "strip_html",
    "tokenize_corpus", "tokenize_query", "tokenize_landmark", "classify_doctrines", "doctrine_dim", "paragraphs", "chunk_paragraphs", "truncate_words", "prune_kept", "prune_dropped", "text_presence", "year_from_date",
    "md5_dedup", "word_token_estimate", "search_links", "prompts", "fenced_replies",
]
QUERIES = {n: globals()[n] for n in _NAMES}
_CTX = r"string_split(regexp_replace(text, '([.!?])[ \t\n\r\f]+', '\1' || chr(1), 'g'), chr(1))"

ORACLES = {
    "extract_citations": f"WITH {_EXTRACT} SELECT doc_id, pos, volume, reporter, page, citation_string FROM cites",
    "citation_context": f"""WITH {_EXTRACT}, d AS (SELECT doc_id, {_CTX} AS s FROM documents),
      j AS (SELECT c.doc_id, c.pos, c.citation_string, s, list_position(list_transform(s, lambda x: contains(x, c.citation_string)), true) AS place FROM cites c JOIN d USING (doc_id))
      SELECT doc_id, pos, citation_string, CASE WHEN place > 0 THEN array_to_string(list_slice(s, greatest(place - 3, 1), place + 3), ' ') END AS context FROM j""",
    "char_window": f"""WITH {_EXTRACT}, j AS (SELECT c.doc_id, c.pos, c.citation_string AS cs, text, instr(text, c.citation_string) AS place FROM cites c JOIN documents USING (doc_id))
      SELECT doc_id, pos, CASE WHEN place > 0 THEN substr(text, greatest(place - 300, 1), place + length(cs) + 300 - greatest(place - 300, 1)) END AS window_text FROM j""",
    "party_names": f"SELECT check_id, trim(nullif(regexp_extract(trim(cited_name), {_q(C.PARTY)}, 1), '')) AS parties FROM name_checks",
    "cited_year": f"SELECT benchmark_id, TRY_CAST(regexp_extract(citation, {_q(C.YEAR)}, 1) AS INTEGER) AS cited_year_found FROM benchmark_items",
    "opinion_id": f"SELECT row_id, TRY_CAST(regexp_extract(opinions_cited, {_q(C.OPINION)}, 1) AS BIGINT) AS first_opinion FROM cases_enriched",
    "sentence_split": f"SELECT doc_id, CAST(generate_subscripts({_CTX}, 1) AS INTEGER) AS pos, unnest({_CTX}) AS sentence FROM documents WHERE text IS NOT NULL",
    "strip_headers": f"SELECT row_id, {_sql_headers('plain_text')} AS out_text FROM cases_enriched",
    "normalize_citations": f"SELECT row_id, {_sql_cites('plain_text')} AS out_text FROM cases_enriched",
    "normalize_ws": f"SELECT row_id, {_sql_space('plain_text')} AS out_text FROM cases_enriched",
    "fix_encoding": f"SELECT row_id, {_sql_encoding('plain_text')} AS out_text FROM cases_enriched",
    "clean_opinions": f"SELECT row_id, CASE WHEN trim(coalesce(plain_text, '')) = '' THEN '' ELSE {_sql_space(_sql_cites(_sql_headers(_sql_encoding('plain_text'))))} END AS out_text FROM cases_enriched",
    "strip_html": r"""WITH h AS (SELECT doc_id, '<p class=''x''>' || replace(text, chr(10), '<br/>&nbsp;&#160;') || '</p>' AS h FROM documents)
      SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(h, '<[^>]+>', ' ', 'g'), '&[a-zA-Z]+;', ' ', 'g'), '&#[0-9]+;', ' ', 'g'), '[ \t\n\r\f]+', ' ', 'g'), '^ | $', '', 'g') AS plain FROM h""",
    "tokenize_corpus": _sql_tokens(_CORPUS),
    "tokenize_query": _sql_tokens(_QUERY),
    "tokenize_landmark": _sql_tokens(f"list_filter({_WORDS.format(c="lower(replace(text, chr(304), 'i' || chr(775)))")}, lambda x: regexp_matches(x, '(?s)^..'))"),
    "classify_doctrines": f"WITH {V.CASES}, {DOCTRINES_SQL} SELECT case_id, doctrine_ids FROM doctrines",
    "doctrine_dim": f"""WITH {V.CASES}, {DOCTRINES_SQL}, e AS (SELECT case_id, unnest(string_split(doctrine_ids, ',')) AS id FROM doctrines)
      SELECT id, array_to_string(list_transform(string_split(id, '_'), lambda w: upper(w[1]) || w[2:]), ' ') AS name, count(*) AS n_cases FROM e GROUP BY id""",
    "paragraphs": r"""WITH p AS (SELECT row_id, list_filter(list_transform(string_split(plain_text, chr(10) || chr(10)), lambda x: regexp_replace(x, '^[ \t\n\r\f]+|[ \t\n\r\f]+$', '', 'g')), lambda x: x <> '') AS p FROM cases_enriched WHERE plain_text IS NOT NULL)
      SELECT row_id, CAST(generate_subscripts(p, 1) AS INTEGER) AS pos, unnest(p) AS paragraph FROM p""",
    "truncate_words": f"SELECT row_id, array_to_string(list_slice({_WORDS.format(c='plain_text')}, 1, 2000), ' ') AS excerpt FROM cases_enriched",
    "prune_kept": f"SELECT row_id, substr(plain_text, 1, {K.MAX_CHARS}) AS plain_text FROM cases_enriched WHERE length(plain_text) >= {K.MIN_CHARS}",
    "prune_dropped": f"SELECT row_id, CAST(length(plain_text) AS INTEGER) AS n_chars FROM cases_enriched WHERE plain_text IS NULL OR length(plain_text) < {K.MIN_CHARS}",
    "text_presence": """SELECT CASE WHEN length(trim(plain_text)) > 0 AND length(trim(citations)) > 0 THEN 'both' WHEN length(trim(plain_text)) > 0 THEN 'plain' WHEN length(trim(citations)) > 0 THEN 'citations' ELSE 'neither' END AS kind, count(*) AS n FROM cases_enriched GROUP BY 1""",
    "year_from_date": "SELECT row_id, TRY_CAST(substr(date_filed, 1, 4) AS INTEGER) AS year FROM cases_enriched",
    "md5_dedup": "SELECT md5(text) AS h, min(doc_id) AS doc_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "word_token_estimate": f"WITH w AS (SELECT row_id, CAST(len({_WORDS.format(c='plain_text')}) AS INTEGER) AS n FROM cases_enriched WHERE plain_text IS NOT NULL) SELECT row_id, n AS n_words, CAST(floor(n * 0.75) AS BIGINT) AS n_tokens FROM w",
    "search_links": "SELECT check_id, CASE WHEN length(cited_name) > 40 THEN substr(cited_name, 1, 37) || '...' ELSE cited_name END AS short_name, replace(replace(replace(url_encode(cited_name), '%20', '+'), '%2A', '*'), '~', '%7E') AS q FROM name_checks WHERE cited_name IS NOT NULL",
    "prompts": "SELECT benchmark_id, 'Citation: ' || coalesce(citation, 'unknown') || chr(10) || 'Proposition: ' || coalesce(context, '') AS prompt FROM benchmark_items",
    "fenced_replies": "SELECT benchmark_id, CASE WHEN benchmark_id % 3 <> 0 AND benchmark_id % 7 = 0 THEN NULL ELSE coalesce(label = 'REAL', false) END AS accurate FROM benchmark_items",
}
