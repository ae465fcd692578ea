"""Text rules over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from .base import Tables, plan

_W = "list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\x0B]+'), lambda x: x <> '')"
_STOP = "['the', 'be', 'to', 'of', 'and', 'that', 'have', 'with']"
_ENGLISH = "[" + ", ".join(f"'{x}'" for x in dict.fromkeys(X.ENGLISH)) + "]"
_BLANK = r"[ \t\f\r\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


@plan("tx01_normalize", rf"""WITH a AS (SELECT doc_id, regexp_replace(regexp_replace(nfc_normalize(text), '[^\PC\n\t]', '', 'g'), '{_BLANK}+', ' ', 'g') AS t FROM documents)
  SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(t, ' \n', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS hash FROM a""")
def normalize(t: Tables):
    from ..operators.prose import composed

    return composed(t.documents.select("doc_id", "text")).select("doc_id", F.sha2(X.canonical(F.col("text")), 256).alias("hash"))


@plan("tx02_is_english", f"""WITH w AS (SELECT doc_id, len(regexp_replace(text, '[^\\p{{Latin}}]', '', 'g')) AS latin, len(regexp_replace(text, '\\PL', '', 'g')) AS letters, len(list_intersect(list_distinct(regexp_extract_all(lower(text), '\\pL+')), {_ENGLISH})) AS stops FROM documents)
  SELECT doc_id, letters > 0 AND latin >= 0.85 * letters AND stops >= 2 AS english FROM w""")
def is_english(t: Tables):
    return t.documents.select("doc_id", X.english(F.col("text")).alias("english"))


_GOPHER = f"""WITH w AS (SELECT doc_id, text, {_W} AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\\S')) AS l FROM documents),
  s AS (SELECT doc_id, len(w) AS n, coalesce(list_sum(list_transform(w, lambda x: len(x))) / nullif(len(w), 0), 0) AS mean, coalesce(len(regexp_extract_all(text, '#|…|\\.\\.\\.')) / nullif(len(w), 0), 0) AS symbols, len(l) AS lines,
    len(list_filter(l, lambda x: regexp_matches(x, '^\\s*[*•·‣◦–—#-]'))) / len(l) AS bullets, len(list_filter(l, lambda x: regexp_matches(x, '(…|\\.\\.\\.)\\s*$'))) / len(l) AS ellipsis,
    len(list_filter(l, lambda x: regexp_matches(x, '\\pL'))) / len(l) AS alpha, len(list_intersect(list_distinct(regexp_extract_all(lower(text), '[a-z]+')), {_STOP})) AS stops FROM w)
  SELECT doc_id, CASE WHEN n < 50 THEN 'too_short' WHEN n > 100000 THEN 'too_long' WHEN mean < 3 OR mean > 10 THEN 'mean_word_len' WHEN symbols >= 0.1 THEN 'symbol_ratio' WHEN lines > 0 AND bullets >= 0.9 THEN 'bullet_lines' WHEN lines > 0 AND ellipsis >= 0.3 THEN 'ellipsis_lines' WHEN lines > 0 AND alpha < 0.8 THEN 'non_alpha_lines' WHEN stops < 2 THEN 'no_stopwords' END AS reason FROM s"""


@plan("tx03_gopher_quality", _GOPHER)
def gopher_quality(t: Tables):
    return t.documents.select("doc_id", X.gopher_reason(F.col("text")).alias("reason"))


@plan("tx04_scrub_pii")
def scrub_pii(t: Tables):
    """No SQL: DuckDB's patterns know no look-around. Tested against the same shapes in Python."""
    return t.documents.select("doc_id", F.sha2(X.scrubbed(F.col("text")), 256).alias("hash"))


@plan("tx05_redaction_counts")
def redaction_counts(t: Tables):
    """Counts by detector, each over what the one before left, and the hash of the redacted text."""
    from ..operators.prose import redacted

    return redacted(t.documents.select("doc_id", "text")).withColumn("text", F.sha2("text", 256)).withColumnRenamed("text", "hash")


@plan("tx06_secret_scan")
def secret_scan(t: Tables):
    from ..operators.prose import secrets_of

    return secrets_of(t.documents.select("doc_id", "text"))


@plan("tx07_signature_pack", "SELECT doc_id, kind, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, unnest(regexp_extract_all(text, '{p.replace(chr(39), chr(39) * 2)}')) AS hit FROM documents" for k, p, _, _ in X.SIGNATURES) + ") GROUP BY ALL")
def signature_pack(t: Tables):
    hits = F.array(*(F.struct(F.lit(k).alias("kind"), F.regexp_count("text", F.lit(p)).cast("long").alias("n")) for k, p, _, _ in X.SIGNATURES))
    return t.documents.select("doc_id", F.explode(F.filter(hits, lambda x: x["n"] > 0)).alias("x")).select("doc_id", "x.*")


@plan("tx08_entropy", """WITH c AS (SELECT p_partkey, unnest(string_split(p_name, '')) AS ch, len(p_name) AS n FROM part), f AS (SELECT p_partkey, ch, count(*) / any_value(n) AS p FROM c GROUP BY p_partkey, ch) SELECT p_partkey, round(-sum(p * log2(p)), 6) AS bits FROM f GROUP BY ALL""")
def entropy(t: Tables):
    return t.part.select("p_partkey", F.round(X.entropy(F.col("p_name")), 6).alias("bits"))


_TOPICS = {"code": r"\b(token|api|def)\b", "law": r"\b(rights|license|copyright)\b"}


@plan("tx09_classify", "SELECT doc_id, " + "CASE " + " ".join(f"WHEN regexp_matches(lower(text), '{p}') THEN '{k}'" for k, p in _TOPICS.items()) + " ELSE 'general' END AS topic, len(regexp_extract_all(lower(text), '\\b(because|therefore|thus)\\b')) AS cues FROM documents")
def classify(t: Tables):
    topic = F.lit("general")
    for k, p in reversed(_TOPICS.items()):
        topic = F.when(F.lower("text").rlike(p), k).otherwise(topic)
    return t.documents.select("doc_id", topic.alias("topic"), F.regexp_count(F.lower("text"), F.lit(r"\b(because|therefore|thus)\b")).cast("long").alias("cues"))


@plan("tx10_cue_level", r"SELECT doc_id, least(5, 2 + len(regexp_extract_all(lower(text), '\b(the|of)\b')) // 20) AS level FROM documents WHERE 2 + len(regexp_extract_all(lower(text), '\b(the|of)\b')) // 20 >= 4")
def cue_level(t: Tables):
    level = 2 + F.floor(F.regexp_count(F.lower("text"), F.lit(r"\b(the|of)\b")) / 20)
    return t.documents.select("doc_id", F.least(F.lit(5), level).alias("level")).where("level >= 4")


@plan("tx11_structure", f"""WITH w AS (SELECT doc_id, len(text) AS n, len(regexp_replace(text, '[^A-Za-z ]', '', 'g')) AS plain, {_W} AS w FROM documents) SELECT doc_id, n BETWEEN 100 AND 10000 AND plain >= 0.6 * n AND (len(w) <= 10 OR len(list_distinct(w)) >= 0.3 * len(w)) AS passes FROM w""")
def structure(t: Tables):
    d, w = t.documents, X.tokens(F.col("text"))
    n, plain = F.length("text"), F.length(F.regexp_replace("text", "[^A-Za-z ]", ""))
    return d.select("doc_id", (n.between(100, 10000) & (plain >= 0.6 * n) & ((F.size(w) <= 10) | (F.size(F.array_distinct(w)) >= 0.3 * F.size(w)))).alias("passes"))


@plan("tx12_sniff_level", "SELECT event_id, CASE WHEN regexp_matches(event_type, 'error|fatal') THEN 'error' WHEN regexp_matches(event_type, 'sign') THEN 'warn' ELSE 'info' END AS level FROM events")
def sniff_level(t: Tables):
    return t.events.select("event_id", F.when(F.col("event_type").rlike("error|fatal"), "error").when(F.col("event_type").rlike("sign"), "warn").otherwise("info").alias("level"))


@plan("tx13_parse_timestamp", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN NULL ELSE o_orderdate END AS ts FROM orders")
def parse_timestamp(t: Tables):
    raw = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "MMM dd yyyy")).otherwise("not a time")
    parsed = F.coalesce(*(F.try_to_timestamp(F.col("raw"), F.lit(f)) for f in ("yyyy-MM-dd'T'HH:mm:ss", "MMM dd yyyy")))
    return t.orders.select("o_orderkey", raw.alias("raw")).select("o_orderkey", parsed.cast("timestamp_ntz").alias("ts"))


_COUNTS = r"""WITH c AS (SELECT doc_id, greatest(len(regexp_extract_all(text, '[.!?]+')), 1)::DOUBLE AS s, greatest(len(regexp_extract_all(text, '[A-Za-z]+')), 1)::DOUBLE AS w, len(regexp_extract_all(lower(text), '[aeiouy]+'))::DOUBLE AS v,
  len(regexp_extract_all(lower(text), '[a-z]*([aeiouy]+[^aeiouy\W]+){2,}[aeiouy]+[a-z]*'))::DOUBLE AS hard, len(regexp_replace(text, '[^A-Za-z]', '', 'g'))::DOUBLE AS l FROM documents)"""


@plan("tx15_readability", _COUNTS + """ SELECT doc_id, floor(floor(1e6::DOUBLE * (206.835::DOUBLE - 1.015::DOUBLE * (w / s) - 84.6::DOUBLE * (v / w))) / 100)::BIGINT AS ease, floor(floor(1e6::DOUBLE * (0.39::DOUBLE * (w / s) + 11.8::DOUBLE * (v / w) - 15.59::DOUBLE)) / 100)::BIGINT AS grade,
  floor(floor(1e6::DOUBLE * (0.4::DOUBLE * ((w / s) + 100.0::DOUBLE * (hard / w)))) / 100)::BIGINT AS fog, floor(floor(1e6::DOUBLE * (0.0588::DOUBLE * (100.0::DOUBLE * l / w) - 0.296::DOUBLE * (100.0::DOUBLE * s / w) - 15.8::DOUBLE)) / 100)::BIGINT AS liau FROM c""")
def readability(t: Tables):
    """The four measures in ten-thousandths."""
    count = lambda p, c="text": F.regexp_count(F.col(c) if isinstance(c, str) else c, F.lit(p)).cast("double")
    low = F.lower("text")
    c = t.documents.select(
        "doc_id", F.greatest(count("[.!?]+"), F.lit(1.0)).alias("s"), F.greatest(count("[A-Za-z]+"), F.lit(1.0)).alias("w"), count("[aeiouy]+", low).alias("v"),
        count(r"[a-z]*([aeiouy]+[^aeiouy\W]+){2,}[aeiouy]+[a-z]*", low).alias("hard"), F.length(F.regexp_replace("text", "[^A-Za-z]", "")).cast("double").alias("l"),
    )
    s, w, v, hard, letters = (F.col(x) for x in ("s", "w", "v", "hard", "l"))
    part = lambda x: F.floor(F.floor(1e6 * x) / 100)
    return c.select(
        "doc_id", part(206.835 - 1.015 * (w / s) - 84.6 * (v / w)).alias("ease"), part(0.39 * (w / s) + 11.8 * (v / w) - 15.59).alias("grade"),
        part(0.4 * ((w / s) + 100.0 * (hard / w))).alias("fog"), part(0.0588 * (100.0 * letters / w) - 0.296 * (100.0 * s / w) - 15.8).alias("liau"),
    )


@plan("tx20_keyword_score", r"SELECT doc_id, (CASE WHEN regexp_matches(lower(substr(text, 1, 80)), '\bthe\b') THEN 6 WHEN regexp_matches(lower(text), '\bthe\b') THEN 3 ELSE 0 END) + (CASE WHEN regexp_matches(lower(substr(text, 1, 80)), '\bder\b') THEN 2 WHEN regexp_matches(lower(text), '\bder\b') THEN 1 ELSE 0 END) AS score FROM documents")
def keyword_score(t: Tables):
    title, text = F.lower(F.substring("text", 1, 80)), F.lower("text")
    each = [F.when(title.rlike(rf"\b{k}\b"), 2 * w).when(text.rlike(rf"\b{k}\b"), w).otherwise(0) for k, w in (("the", 3), ("der", 1))]
    return t.documents.select("doc_id", sum(each[1:], each[0]).alias("score"))


@plan("tx21_canonical_url", r"""SELECT page_id, 'https://' || regexp_replace(lower(regexp_extract(url, '^https?://([^/?#]+)', 1)), '^(www|m)\.', '') || regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1)
  || CASE WHEN regexp_matches(url, '[?&]page=') THEN '?page=' || regexp_extract(url, '[?&]page=([^&#]*)', 1) ELSE '' END AS canonical FROM pages""")
def canonical_url(t: Tables):
    host = F.regexp_replace(F.lower(F.regexp_extract("url", r"^https?://([^/?#]+)", 1)), r"^(www|m)\.", "")
    page = F.regexp_extract("url", r"[?&]page=([^&#]*)", 1)
    query = F.when(F.col("url").rlike(r"[?&]page="), F.concat(F.lit("?page="), page)).otherwise("")
    return t.pages.select("page_id", F.concat(F.lit("https://"), host, F.regexp_extract("url", r"^https?://[^/?#]+([^?#]*)", 1), query).alias("canonical"))


@plan("tx22_url_key", "SELECT page_id, sha256(url) AS key, regexp_matches(regexp_extract(url, '^https?://([^/?#]+)', 1), 'example\\.(com|org)$') AS allowed FROM pages")
def url_key(t: Tables):
    return t.pages.select("page_id", F.sha2("url", 256).alias("key"), F.regexp_extract("url", r"^https?://([^/?#]+)", 1).rlike(r"example\.(com|org)$").alias("allowed"))


@plan("tx25_visible_text", r"SELECT page_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style|nav|footer)\b.*?</(script|style|nav|footer)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \t\n]+', ' ', 'g'), ' ')) AS hash FROM pages")
def visible_text(t: Tables):
    bare = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style|nav|footer)\b.*?</(script|style|nav|footer)>", " "), "<[^>]*>", " ")
    return t.pages.select("page_id", F.sha2(F.trim(F.regexp_replace(bare, r"[ \t\n]+", " ")), 256).alias("hash"))


@plan("tx26_strip_html", "SELECT page_id, substr(trim(regexp_replace(html, '<[^>]+>', ' ', 'g'), ' '), 1, 1000) AS summary FROM pages")
def strip_html(t: Tables):
    return t.pages.select("page_id", F.substring(F.trim(F.regexp_replace("html", "<[^>]+>", " ")), 1, 1000).alias("summary"))


@plan("tx27_duplicate_titles", r"SELECT substr(sha1(lower(regexp_extract(html, '<title>([^<]*)</title>', 1))), 1, 12) AS fingerprint, count(*) AS n FROM pages GROUP BY ALL HAVING count(*) >= 2")
def duplicate_titles(t: Tables):
    mark = F.substring(F.sha1(F.lower(F.regexp_extract("html", "<title>([^<]*)</title>", 1))), 1, 12).alias("fingerprint")
    return t.pages.groupBy(mark).agg(F.count("*").alias("n")).where("n >= 2")


@plan("tx28_page_audit", r"SELECT page_id, array_to_string(list_filter([CASE WHEN NOT contains(html, '<h1') THEN 'no_h1' END, CASE WHEN NOT contains(html, 'name=""description""') THEN 'no_description' END, CASE WHEN NOT contains(html, '</html>') THEN 'unclosed' END, CASE WHEN starts_with(url, 'http:') THEN 'insecure' END], lambda x: x IS NOT NULL), ',') AS findings FROM pages".replace('""', '"'))
def page_audit(t: Tables):
    from ..functions.columns import reasons

    h = F.col("html")
    found = reasons(("no_h1", ~h.contains("<h1")), ("no_description", ~h.contains('name="description"')), ("unclosed", ~h.contains("</html>")), ("insecure", F.col("url").startswith("http:")))
    return t.pages.select("page_id", F.array_join(found, ",").alias("findings"))


@plan("tx31_flatten_conversations", "SELECT conv_id, sha256(string_agg('<|' || role || '|>' || chr(10) || text, chr(10) ORDER BY turn)) AS hash, count(*) AS parts FROM conversations GROUP BY conv_id HAVING count(*) >= 2 AND bool_or(role = 'assistant')")
def flatten_conversations(t: Tables):
    part = F.concat(F.lit("<|"), "role", F.lit("|>\n"), "text")
    turns = F.array_sort(F.collect_list(F.struct("turn", part.alias("part"))))
    g = t.conversations.groupBy("conv_id").agg(turns.alias("turns"), F.count("*").alias("parts"), F.bool_or(F.col("role") == "assistant").alias("answered")).where("parts >= 2 and answered")
    return g.select("conv_id", F.sha2(F.array_join(F.transform("turns", lambda x: x["part"]), "\n"), 256).alias("hash"), "parts")


@plan("tx32_tool_action", "SELECT event_id, CASE WHEN regexp_matches(event_type, '^(error|drop)') THEN 'halt' WHEN regexp_matches(event_type, 'purchase|pay') THEN 'escalate' ELSE 'execute' END AS action FROM events")
def tool_action(t: Tables):
    return t.events.select("event_id", F.when(F.col("event_type").rlike("^(error|drop)"), "halt").when(F.col("event_type").rlike("purchase|pay"), "escalate").otherwise("execute").alias("action"))


@plan("tx33_eval_marker", "SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)all rights reserved|benchmark|canary')")
def eval_marker(t: Tables):
    return t.documents.where(F.col("text").rlike("(?i)all rights reserved|benchmark|canary")).select("doc_id")


_LUM = "(0.2126 * {r} + 0.7152 * {g} + 0.0722 * {b})"
_LIN = "CASE WHEN {c} / 255.0 <= 0.03928 THEN {c} / 255.0 / 12.92 ELSE power(({c} / 255.0 + 0.055) / 1.055, 2.4) END"


@plan("tx34_contrast", "SELECT p_partkey, round((1 + 0.05) / (" + _LUM.format(r="(" + _LIN.format(c="(p_partkey % 256)") + ")", g="(" + _LIN.format(c="(p_size * 5 % 256)") + ")", b="(" + _LIN.format(c="(p_partkey * 7 % 256)") + ")") + " + 0.05), 4) AS ratio FROM part")
def contrast(t: Tables):
    def linear(c):
        x = c / 255.0
        return F.when(x <= 0.03928, x / 12.92).otherwise(F.pow((x + 0.055) / 1.055, F.lit(2.4)))

    k, s = F.col("p_partkey"), F.col("p_size")
    lum = 0.2126 * linear(k % 256) + 0.7152 * linear(s * 5 % 256) + 0.0722 * linear(k * 7 % 256)
    return t.part.select("p_partkey", F.round(1.05 / (lum + 0.05), 4).alias("ratio"))


@plan("tx16_syllables")
def syllables(t: Tables):
    from ..operators.prose import syllable_counts

    return syllable_counts(t.documents.select("doc_id", "text"))


@plan("tx17_sentences")
def sentences(t: Tables):
    from ..operators.prose import sentence_counts

    return sentence_counts(t.documents.select("doc_id", "text"))
