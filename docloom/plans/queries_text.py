"""Queries of sources, text functions, lexicons and features."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import commands
from ..functions import features as X
from ..functions import text as T
from ..operators import gazetteer, layout
from ..operators import tokens as K
from ..operators.assembly import entity_json
from ..operators.evaluation import sentences_outside
from ..operators.vectors import KNOWN_OF, VECTORS, vector
from ..sources import files
from .registry import Literal, query, table

TOK = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}|\p{L}+|\p{N}+|[^\p{L}\p{N}]"
#: doc_id, pos, tok, char_offset of all tokens
TOKENS = f"""
raw AS (SELECT doc_id, regexp_extract_all(text, '{TOK}') AS toks FROM documents),
ex AS (SELECT doc_id, CAST(generate_subscripts(toks, 1) - 1 AS BIGINT) AS pos, unnest(toks) AS tok FROM raw),
tk AS (SELECT *, CAST(coalesce(sum(length(tok)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS char_offset FROM ex),
solid AS (SELECT * FROM tk WHERE NOT regexp_matches(tok, '^\\s$'))"""
TOKENS = TOKENS.replace("\\\\", "\\")
LINES = r"""
rl AS (SELECT doc_id, regexp_split_to_array(text, '[\n\r]') AS ls FROM documents),
el AS (SELECT doc_id, CAST(generate_subscripts(ls, 1) - 1 AS BIGINT) AS line_no, unnest(ls) AS line FROM rl),
bl AS (SELECT *, CAST(sum(CASE WHEN trim(line) = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS BIGINT) AS block_no, CAST(floor(line_no / 40) AS BIGINT) AS page FROM el),
ln AS (SELECT * FROM bl WHERE trim(line) <> '')"""


@query("SELECT doc_id, upper(md5(coalesce(text, ''))) AS md5 FROM documents")
def text_digest(spark, d):
    return table(spark, d, "documents").select("doc_id", F.upper(F.md5(F.coalesce("text", F.lit("")))).alias("md5"))


@query("""SELECT doc_id AS "Document_ID", translate(text, chr(13) || chr(10) || chr(9) || ';', '   ,') AS "Raw_Text" FROM documents""")
def export_flatten(spark, d):
    return files.export_rows(table(spark, d, "documents"))


@query(f"WITH {LINES} SELECT doc_id, line_no, page FROM ln WHERE page BETWEEN 0 AND 2")
def page_window(spark, d):
    return layout.text_lines(table(spark, d, "documents")).where("page between 0 and 2").select("doc_id", "line_no", "page")


LEX = Literal(
    "term string,class string",
    ("The", "anatomy"), ("of the", "anatomy"), ("and the", "pathology"), ("THE ", "anatomy"), ("la", "living"), ("de la", "living"), ("der", "device"), ("die der", "device"), ("in the", "location"), ("the in the", "location"), ("que", "substance"), ("", "object"), ("of", "object"), ("is", "phenomenon"), ("was the", "physiology"), ("trash", "procedure"),
)
LEX_SQL = rf"lex AS (SELECT DISTINCT lower(trim(term)) AS term_lower, class FROM {LEX.sql} WHERE trim(term) <> ''), lx AS (SELECT *, CAST(len(list_filter(regexp_extract_all(term_lower, '\p{{L}}+|\p{{N}}+|[^\p{{L}}\p{{N}}]'), lambda t: NOT regexp_matches(t, '^\s$'))) AS BIGINT) AS n_tokens FROM lex)"


@query(f"WITH {LEX_SQL} SELECT term_lower, class, n_tokens FROM lx")
def lexicon_source(spark, d):
    return gazetteer.lexicon(LEX.df(spark)).select("term_lower", "class", "n_tokens")


PAIR_LINES = Literal("line string", ("Dupont\tMartin",), ("75001\t38291",), ("a b\tc d",))


@query(f"SELECT split_part(line, chr(9), 1) AS original, split_part(line, chr(9), 2) AS pseudo FROM {PAIR_LINES.sql}")
def pair_source(spark, d):
    return files.parse_pairs(PAIR_LINES.df(spark), "line")


@query(r"""WITH b AS (SELECT page_id, coalesce(html, '') AS html, regexp_replace(coalesce(html, ''), '(?is)<(script|style|nav)[^>]*>.*?</(?:script|style|nav)>|<!--.*?-->', ' ', 'g') AS bare FROM pages),
c AS (SELECT page_id, html, regexp_extract(bare, '(?is)<body[^>]*>(.*)', 1) AS body, regexp_extract(html, '(?is)<nav[^>]*>(.*?)</nav>', 1) AS nav FROM b)
SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title, regexp_extract(html, '(?i)<html[^>]*lang="([A-Za-z-]+)"', 1) AS lang,
 CAST(len(regexp_extract_all(nav, '(?i)<a ')) AS BIGINT) AS nav_links, CAST(len(regexp_extract_all(body, '(?i)<p[ >]')) AS BIGINT) AS n_paragraphs,
 trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(body, '(?s)<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g')) AS body FROM c""")
def html_zones(spark, d):
    return files.html_zones(table(spark, d, "pages"))


@query(f"WITH {TOKENS} SELECT doc_id, pos, tok, char_offset FROM tk")
def tokens_delim(spark, d):
    return K.explode_tokens(table(spark, d, "documents")).select("doc_id", F.col("pos").cast("long").alias("pos"), "tok", "char_offset")


@query(r"SELECT doc_id, CAST(generate_subscripts(t, 1) - 1 AS BIGINT) AS pos, unnest(t) AS tok FROM (SELECT doc_id, regexp_extract_all(text, '\S+') AS t FROM documents)")
def tokens_ws(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode_outer(T.white_tokens(F.col("text"))).alias("pos", "tok")).where("pos is not null").withColumn("pos", F.col("pos").cast("long"))


@query(f"WITH {LINES} SELECT doc_id, line_no, line, block_no, page FROM ln")
def lines_pos(spark, d):
    return layout.text_lines(table(spark, d, "documents"))


@query(r"SELECT doc_id, pos, para FROM (SELECT doc_id, CAST(generate_subscripts(p, 1) - 1 AS BIGINT) AS pos, unnest(p) AS para FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)) WHERE trim(para) <> ''")
def paragraphs(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "para")).where("trim(para) <> ''").withColumn("pos", F.col("pos").cast("long"))


@query("WITH " + LINES + r", o AS (SELECT *, regexp_extract(line, '([^ \t\f\x{00A0}]+)', 1) AS head, regexp_extract(line, '[^ \t\f\x{00A0}]+[ \t\f\x{00A0}]+([^ \t\f\x{00A0}]+)', 1) AS second FROM ln) SELECT doc_id, line_no, head, second FROM o WHERE NOT regexp_matches(line, '@IMAGE|@PAGE|\.(pbm|ppm|png|svg|jpg)')")
def first_tokens(spark, d):
    return layout.text_lines(table(spark, d, "documents")).where(~T.is_marker(F.col("line"))).select("doc_id", "line_no", T.first_token(F.col("line")).alias("head"), T.second_token(F.col("line")).alias("second"))


@query(r"SELECT doc_id, md5(regexp_replace(text, '\s', '', 'g')) AS bare, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS normal, md5(regexp_replace(text, '(\p{L})-[ \t]*\r?\n[ \t]*(\p{Ll})', '\1\2', 'g')) AS joined FROM documents")
def space_functions(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.md5(T.strip_spaces(t)).alias("bare"), F.md5(T.normalize_space(t)).alias("normal"), F.md5(T.dehyphenize(t)).alias("joined"))


@query("SELECT turn, conv_id, array_to_string(list_transform(string_split(text, ' '), lambda w: CASE WHEN starts_with(w, 'ß') THEN 'Ss' ELSE upper(substr(w, 1, 1)) END || lower(substr(w, 2))), ' ') AS title FROM conversations")
def title_case(spark, d):
    """The sharp s has no single capital: at the start of a word it becomes Ss, its title case in Unicode."""
    return table(spark, d, "conversations").select("turn", "conv_id", T.title_case(F.col("text")).alias("title"))


@query("SELECT doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;') AS escaped FROM documents")
def xml_escape(spark, d):
    return table(spark, d, "documents").select("doc_id", T.xml_escape(F.col("text")).alias("escaped"))


STRINGS = Literal(
    "id bigint,a string,b string",
    (1, "Jean-Paul DUPONT", "jean-paul  dupont"), (2, "JM", "J M"), (3, "(Dr) Martin", "Dr Martin"), (4, "@BULLET item one", "item-one"), (5, "Hôpital Saint-Louis", "hopital saint louis"), (6, "paul.martin@chu.fr", "paul"),
    (7, "de", "DE"), (8, "Service d'urgence", "urgence"), (9, "le Roux", "ROUX"), (10, "A", ""), (11, "12-34", "1234"),
)


@query(f"""SELECT id, replace(a, '@BULLET', '•') AS bullet, lower(replace(a, ' ', '')) = lower(replace(b, ' ', '')) AS same, contains(translate(lower(a), ' -', ''), translate(lower(b), ' -', '')) AS holds,
 trim(regexp_replace(a, '[()\\[\\]{{}}]', '', 'g')) AS bare, array_to_string(string_split(string_split(a, '@')[1], '.'), '|') AS local_parts, lower(a) IN ({", ".join(f"'{x}'" for x in T.DETERMINERS)}) AS determiner,
 CASE WHEN regexp_matches(a, '^\\p{{Lu}}{{2}}$') THEN substr(a, 1, 1) || ' ' || substr(a, 2, 1) ELSE array_to_string(list_transform(regexp_extract_all(lower(a), '[^ .,;:/_-]+|[ .,;:/_-]'), lambda p: upper(substr(p, 1, 1)) || substr(p, 2)), '') END AS name
 FROM {STRINGS.sql}""")
def string_functions(spark, d):
    a, b = F.col("a"), F.col("b")
    return STRINGS.df(spark).select("id", T.bullets(a).alias("bullet"), T.same_content(a, b).alias("same"), T.contains_content(a, b).alias("holds"), T.strip_brackets(a).alias("bare"), F.array_join(T.local_parts(a), "|").alias("local_parts"), T.is_determiner(a).alias("determiner"), T.capitalize_name(a).alias("name"))


_SCORES = ", ".join(f"CAST(len(list_filter(w, lambda x: x IN ({', '.join(repr(s) for s in stop)}))) AS BIGINT) AS {lang}" for lang, stop in T.STOP_WORDS.items())


@query(rf"WITH s AS (SELECT doc_id, {_SCORES} FROM (SELECT doc_id, regexp_split_to_array(lower(substr(text, 1, 200)), '[^\p{{L}}]+') AS w FROM documents)) SELECT *, CASE WHEN greatest(en, fr, de, es) = 0 THEN 'und' WHEN en >= greatest(fr, de, es) THEN 'en' WHEN fr >= greatest(de, es) THEN 'fr' WHEN de >= es THEN 'de' ELSE 'es' END AS lang_detected, 'fr' AS lang FROM s")
def lang_score(spark, d):
    """Both the detected language and the one that documents are handled in."""
    rows = table(spark, d, "documents").select("doc_id", T.language_scores(F.col("text")).alias("s"))
    return rows.select("doc_id", "s.*", T.detected_language(F.col("s")).alias("lang_detected"), F.lit("fr").alias("lang"))


COMPOSED = Literal("id bigint,text string", (1, "He\u0301le\u0300ne"), (2, "Hélène"), (3, "a\u0308 o\u0327"), (4, ""), (5, None))


@query(f"SELECT id, nfc_normalize(text) AS text FROM {COMPOSED.sql}")
def unicode_composition(spark, d):
    return COMPOSED.df(spark).select("id", T.nfc(F.col("text")).alias("text"))


@query(r"""WITH s AS (SELECT doc_id, regexp_extract_all(text, '(?s).+?(?:[.!?]+\s+|$)') AS t FROM documents), e AS (SELECT doc_id, CAST(generate_subscripts(t, 1) - 1 AS BIGINT) AS pos, unnest(t) AS sentence FROM s)
SELECT doc_id, pos, sentence, CAST(coalesce(sum(length(sentence)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS char_offset FROM e""")
def sentences(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    dealt = table(spark, d, "documents").select("doc_id", "text").repartition("doc_id")
    rows = dealt.select("doc_id", F.posexplode_outer(T.sentences(F.col("text"))).alias("pos", "sentence")).where("pos is not null")
    return rows.select("doc_id", F.col("pos").cast("long").alias("pos"), "sentence", F.coalesce(F.sum(F.length("sentence")).over(w), F.lit(0)).cast("long").alias("char_offset"))


QUOTED = Literal("doc_id bigint,text string", (1, "Voir (fig. 2. La suite) ici. Fin de ligne! [1. 2. 3] reste. Ok"), (2, "Rien. Encore."), (3, "Un (b. c) d. (e. f) g"))


@query(r"""WITH s AS (SELECT doc_id, text, regexp_extract_all(text, '(?s).+?(?:[.!?]+\s+|$)') AS t FROM """ + QUOTED.sql + r"""), e AS (SELECT doc_id, text, CAST(generate_subscripts(t, 1) AS BIGINT) AS pos, unnest(t) AS sentence FROM s),
o AS (SELECT *, CAST(sum(length(sentence)) OVER (PARTITION BY doc_id ORDER BY pos) AS BIGINT) AS fin FROM e),
x AS (SELECT *, fin - length(sentence) AS start, length(regexp_replace(substr(text, 1, CAST(fin - length(sentence) AS INTEGER)), '[(\[][^)\]]*[)\]]', '', 'g')) AS bare FROM o),
j AS (SELECT *, regexp_matches(substr(text, 1, CAST(start AS INTEGER)), '[(\[][^)\]]*$') AS inside FROM x),
g AS (SELECT *, sum(CAST(NOT inside AS INT)) OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM j) SELECT doc_id, CAST(min(start) AS BIGINT) AS start, CAST(max(fin) AS BIGINT) AS "end" FROM g GROUP BY doc_id, g""")
def sentences_outside_spans(spark, d):
    return sentences_outside(QUOTED.df(spark))


DATES = Literal("id bigint,y bigint,m bigint,d bigint,raw string", (1, 2019, 3, 7, "07/03/2019"), (2, 2019, -1, 7, "7-3-2019"), (3, 812, 12, -1, "07.03.2019"), (4, -1, 2, 3, "7 mars 2019"), (5, 1999, 12, 31, "1er août 1999"), (6, 2000, 2, 30, "30/02/2000"), (7, 2020, 1, 1, "2020-01-05"), (8, 2021, 1, -1, "hier"), (9, 2021, 5, 5, "07/03/19"))
_M = "[" + ", ".join(f"'{m}'" for m in T.MONTHS) + "]"


@query(rf"""WITH t AS (SELECT *, lower(trim(regexp_replace(raw, '\s+', ' ', 'g'))) AS t FROM {DATES.sql}), u AS (SELECT *, CASE
 WHEN regexp_matches(t, '^\d{{1,2}}([/.-])\d{{1,2}}[/.-]\d{{4}}$') THEN regexp_extract(t, '(\d{{4}})$', 1) || '-' || lpad(regexp_extract(t, '^\d+[/.-](\d+)', 1), 2, '0') || '-' || lpad(regexp_extract(t, '^(\d+)', 1), 2, '0')
 WHEN regexp_matches(t, '^\d{{4}}-\d{{2}}-\d{{2}}$') THEN t
 WHEN list_position({_M}, regexp_extract(t, '^(\d{{1,2}})(?:er)? (\p{{L}}+) (\d{{4}})$', 2)) > 0 THEN regexp_extract(t, '(\d{{4}})$', 1) || '-' || lpad(CAST(list_position({_M}, regexp_extract(t, ' (\p{{L}}+) ', 1)) AS VARCHAR), 2, '0') || '-' || lpad(regexp_extract(t, '^(\d+)', 1), 2, '0') END AS iso FROM t)
SELECT id, CASE WHEN y = -1 THEN '' WHEN m = -1 THEN lpad(CAST(y AS VARCHAR), 4, '0') WHEN d = -1 THEN lpad(CAST(y AS VARCHAR), 4, '0') || '-' || lpad(CAST(m AS VARCHAR), 2, '0') ELSE lpad(CAST(y AS VARCHAR), 4, '0') || '-' || lpad(CAST(m AS VARCHAR), 2, '0') || '-' || lpad(CAST(d AS VARCHAR), 2, '0') END AS partial,
 CAST(TRY_CAST(iso AS DATE) AS VARCHAR) AS iso, CAST(CASE WHEN regexp_matches(raw, '^\d{{1,2}}/\d{{1,2}}/\d{{4}}$') THEN 1 WHEN regexp_matches(raw, '^\d{{1,2}}/\d{{1,2}}/\d{{2}}$') THEN 2 WHEN regexp_matches(raw, '^\d{{1,2}}-\d{{1,2}}-\d{{4}}$') THEN 3 WHEN regexp_matches(raw, '^\d{{1,2}}\.\d{{1,2}}\.\d{{4}}$') THEN 4 WHEN regexp_matches(raw, '^\d{{4}}-\d{{1,2}}-\d{{1,2}}$') THEN 5 WHEN regexp_matches(raw, '^\d{{1,2}} \p{{L}}+ \d{{4}}$') THEN 6 ELSE 0 END AS BIGINT) AS shape FROM u""")
def date_functions(spark, d):
    return DATES.df(spark).select("id", T.partial_iso(F.col("y"), F.col("m"), F.col("d")).alias("partial"), T.raw_date(F.col("raw")).alias("iso"), T.date_shape(F.col("raw")).alias("shape"))


HEADS = Literal("id bigint,head string", (1, "1.2 Motif"), (2, "IV. Suite"), (3, "A. Annexe"), (4, "Conclusion"), (5, "3 Examens et 2 notes"), (6, "12notes"))


@query(r"""SELECT id, CASE WHEN regexp_matches(head, '^(\d+(?:\.\d+)*\.?)\s+(.*)$') THEN regexp_extract(head, '^(\d+(?:\.\d+)*\.?)\s+(.*)$', 1) WHEN regexp_matches(head, '^([IVXLC]+\.?)\s+(.*)$') THEN regexp_extract(head, '^([IVXLC]+\.?)\s+(.*)$', 1) WHEN regexp_matches(head, '^([A-Z]\.)\s+(.*)$') THEN regexp_extract(head, '^([A-Z]\.)\s+(.*)$', 1) ELSE '' END AS number,
 CASE WHEN regexp_matches(head, '^(?:\d+(?:\.\d+)*\.?|[IVXLC]+\.?|[A-Z]\.)\s+') THEN regexp_extract(head, '^\S+\s+(.*)$', 1) ELSE head END AS title, regexp_extract(head, '^(\d+)(.*)', 1) AS note, CASE WHEN regexp_matches(head, '^\d+') THEN regexp_extract(head, '^(\d+)(.*)', 2) ELSE head END AS rest FROM """ + HEADS.sql)
def heading_numbers(spark, d):
    (number, title), (note, rest) = T.section_number(F.col("head")), T.note_number(F.col("head"))
    return HEADS.df(spark).select("id", number.alias("number"), title.alias("title"), note.alias("note"), rest.alias("rest"))


LABEL = r"""lb AS (SELECT *, CASE WHEN contains(tok, '@') AND length(tok) > 1 THEN 'email' WHEN regexp_matches(tok, '^\p{N}+$') AND length(tok) >= 6 THEN 'idno' WHEN regexp_matches(tok, '^\p{N}+$') THEN 'value' WHEN regexp_matches(tok, '^\p{Lu}\p{L}+$') THEN 'persname' ELSE 'other' END AS label FROM solid),
br AS (SELECT *, CASE WHEN lag(label) OVER (PARTITION BY doc_id ORDER BY pos) IS DISTINCT FROM label THEN 1 ELSE 0 END AS b FROM lb),
cl AS (SELECT *, CAST(sum(b) OVER (PARTITION BY doc_id ORDER BY pos) AS BIGINT) AS cluster_no FROM br),
sp AS (SELECT doc_id, cluster_no, label AS type, min(char_offset) AS offset_start, max(char_offset + length(tok)) AS offset_end FROM cl WHERE label <> 'other' GROUP BY ALL),
en AS (SELECT sp.doc_id, type, CAST(offset_start AS BIGINT) AS offset_start, CAST(offset_end AS BIGINT) AS offset_end, substr(text, CAST(offset_start + 1 AS BIGINT), CAST(offset_end - offset_start AS BIGINT)) AS raw_name FROM sp JOIN documents USING (doc_id))"""


@query(f"WITH {TOKENS}, {LABEL} SELECT * FROM en")
def entities(spark, d):
    return K.entities(table(spark, d, "documents"))


@query(f"WITH {TOKENS}, {LABEL} SELECT type, count(*) AS n, count(DISTINCT doc_id) AS docs FROM en GROUP BY type")
def entities_by_type(spark, d):
    return K.entity_spans(table(spark, d, "documents")).groupBy("type").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


@query(f"""WITH {TOKENS}, {LABEL} SELECT doc_id, offset_start, '{{"rawName":' || CAST(to_json(raw_name) AS VARCHAR) || ',"type":"' || type || '","offsetStart":' || offset_start || ',"offsetEnd":' || offset_end || '}}' AS json FROM en""")
def entity_text_json(spark, d):
    return K.entities(table(spark, d, "documents")).select("doc_id", "offset_start", entity_json().alias("json"))


_MEMBER = ", ".join(f"CAST(max(CASE WHEN l.class = '{c}' THEN 1 ELSE 0 END) AS INTEGER) AS is_{c}" for c in gazetteer.CLASSES)
_SUMS = ", ".join(f"CAST(sum(is_{c}) AS BIGINT) AS {c}" for c in gazetteer.CLASSES)


@query(f"WITH {TOKENS}, {LEX_SQL}, m AS (SELECT s.doc_id, s.pos, {_MEMBER} FROM solid s LEFT JOIN lx l ON lower(s.tok) = l.term_lower GROUP BY ALL) SELECT doc_id, {_SUMS} FROM m GROUP BY doc_id")
def gazetteer_member(spark, d):
    toks = K.explode_tokens(table(spark, d, "documents")).where(~F.col("tok").rlike(r"^\s$"))
    return gazetteer.members(toks, gazetteer.lexicon(LEX.df(spark))).groupBy("doc_id").agg(*[F.sum(f"is_{c}").alias(c) for c in gazetteer.CLASSES])


#: Spans of one to three tokens; per class and start the longest; then left to right without overlap.
SPANS = r"""nb AS (SELECT doc_id, lower(tok) AS t0, CAST(row_number() OVER w - 1 AS BIGINT) AS n_start, lead(lower(tok), 1) OVER w AS t1, lead(lower(tok), 2) OVER w AS t2 FROM solid WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
fd AS (SELECT doc_id, class, n_start, n_start + n_tokens - 1 AS n_end, term_lower AS term FROM nb JOIN lx ON (n_tokens = 1 AND term_lower = t0) OR (n_tokens = 2 AND term_lower = t0 || ' ' || t1) OR (n_tokens = 3 AND term_lower = t0 || ' ' || t1 || ' ' || t2)),
bs AS (SELECT doc_id, class, n_start, max(n_end) AS n_end, max_by(term, n_end) AS term, row_number() OVER (PARTITION BY doc_id, class ORDER BY n_start) AS k FROM fd GROUP BY doc_id, class, n_start),
kp AS (SELECT doc_id, class, k, n_start, n_end, term, true AS keep, n_end AS reach FROM bs WHERE k = 1 UNION ALL
 SELECT b.doc_id, b.class, b.k, b.n_start, b.n_end, b.term, b.n_start > p.reach, CASE WHEN b.n_start > p.reach THEN b.n_end ELSE p.reach END FROM kp p JOIN bs b ON b.doc_id = p.doc_id AND b.class = p.class AND b.k = p.k + 1)"""


@query(f"WITH RECURSIVE {TOKENS}, {LEX_SQL}, {SPANS} SELECT doc_id, class, n_start, n_end, term FROM kp WHERE keep")
def gazetteer_spans(spark, d):
    return gazetteer.phrase_spans(K.explode_tokens(table(spark, d, "documents")), gazetteer.lexicon(LEX.df(spark)))


@query(f"WITH RECURSIVE {TOKENS}, {LEX_SQL}, {SPANS} SELECT DISTINCT n.doc_id, n.n_start AS n, class FROM nb n JOIN kp ON n.doc_id = kp.doc_id AND kp.keep AND n.n_start BETWEEN kp.n_start AND kp.n_end")
def token_in_span(spark, d):
    toks = K.explode_tokens(table(spark, d, "documents"))
    return gazetteer.tokens_in_spans(toks, gazetteer.phrase_spans(toks, gazetteer.lexicon(LEX.df(spark)))).select("doc_id", "n", "class")


@query(r"""SELECT doc_id, 'email' AS kind, unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')) AS found FROM documents UNION ALL SELECT doc_id, 'url', unnest(regexp_extract_all(text, '(?:https?://|www\.)[^\s<>"]+')) FROM documents""")
def email_url_spans(spark, d):
    return gazetteer.email_url_spans(table(spark, d, "documents"))


_SHAPE = r"translate(regexp_replace(regexp_replace(regexp_replace(regexp_replace(tok, '[^\p{Lu}\p{Ll}\p{N}]', chr(1), 'g'), '\p{Lu}', chr(2), 'g'), '\p{Ll}', chr(3), 'g'), '\p{N}', chr(4), 'g'), chr(1) || chr(2) || chr(3) || chr(4), 'cXxd')"
_LEXICAL = rf"""CASE WHEN regexp_matches(tok, '^\p{{N}}+$') THEN 'NOCAPS' WHEN regexp_matches(tok, '^\p{{Lu}}+$') THEN 'ALLCAP' WHEN regexp_matches(tok, '^\p{{Lu}}') THEN 'INITCAP' ELSE 'NOCAPS' END AS caps,
 CASE WHEN regexp_matches(tok, '^\p{{N}}+$') THEN 'ALLDIGIT' WHEN regexp_matches(tok, '\p{{N}}') THEN 'CONTAINSDIGITS' ELSE 'NODIGIT' END AS digit, CAST(length(tok) = 1 AS INTEGER) AS single,
 CASE WHEN tok IN ('(', '[', '{{') THEN 'OPENBRACKET' WHEN tok IN (')', ']', '}}') THEN 'ENDBRACKET' WHEN tok = '.' THEN 'DOT' WHEN tok = ',' THEN 'COMMA' WHEN tok IN ('-', '–') THEN 'HYPHEN' WHEN tok IN ('"', '''', '`', '’') THEN 'QUOTE' WHEN regexp_matches(tok, '^\p{{P}}+$') THEN 'PUNCT' ELSE 'NOPUNCT' END AS punct,
 {", ".join(f"left(lower(tok), {n}) AS p{n}, right(lower(tok), {n}) AS s{n}" for n in range(1, 6))}, {_SHAPE} AS shape, regexp_replace(regexp_replace(regexp_replace(regexp_replace({_SHAPE}, 'c+', 'c', 'g'), 'X+', 'X', 'g'), 'x+', 'x', 'g'), 'd+', 'd', 'g') AS trimmed,
 CAST(regexp_matches(tok, '^(19|20)[0-9]{{2}}$') AS INTEGER) AS year, CAST(lower(tok) IN ({", ".join(f"'{m}'" for m in T.MONTHS)}) AS INTEGER) AS month, CAST(regexp_matches(tok, '^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}$') AS INTEGER) AS email, CAST(regexp_matches(tok, '^(https?://|www\.)') AS INTEGER) AS http"""


def lexical_columns():
    t, low = F.col("tok"), F.lower("tok")
    parts = [c for n in range(1, 6) for c in (X.prefix(low, n).alias(f"p{n}"), X.suffix(low, n).alias(f"s{n}"))]
    return [X.capitalisation(t).alias("caps"), X.digits(t).alias("digit"), X.single_char(t).alias("single"), X.punctuation(t).alias("punct"), *parts, X.shape(t).alias("shape"), X.trimmed_shape(X.shape(t)).alias("trimmed"), X.flag(X.is_year(t)).alias("year"), X.flag(X.is_month(t)).alias("month"), X.flag(X.is_email(t)).alias("email"), X.flag(X.is_http(t)).alias("http")]


@query(f"WITH {TOKENS}, t AS (SELECT tok, count(*) AS n FROM solid GROUP BY tok) SELECT tok, n, {_LEXICAL} FROM t")
def token_features(spark, d):
    """Features depend on the token alone, so they are derived once for each distinct one."""
    toks = K.explode_tokens(table(spark, d, "documents")).where(~F.col("tok").rlike(r"^\s$")).groupBy("tok").agg(F.count("*").alias("n"))
    return toks.select("tok", "n", *lexical_columns())


@query(f"WITH {LINES}, p AS (SELECT *, regexp_replace(line, '[^\\p{{P}}]', '', 'g') AS prof FROM ln) SELECT doc_id, line_no, CASE WHEN prof = '' THEN 'no' ELSE prof END AS profile, CAST(length(prof) AS BIGINT) AS size FROM p")
def punct_profile(spark, d):
    rows = layout.text_lines(table(spark, d, "documents"))
    return rows.select("doc_id", "line_no", X.profile_or_no(F.col("line")).alias("profile"), F.length(X.punctuation_profile(F.col("line"))).cast("long").alias("size"))


_STATUS = "CASE WHEN row_number() OVER (PARTITION BY {p} ORDER BY line_no) = 1 THEN '{n}START' WHEN lead(1) OVER (PARTITION BY {p} ORDER BY line_no) IS NULL THEN '{n}END' ELSE '{n}IN' END"


@query(f"WITH {LINES} SELECT doc_id, line_no, {_STATUS.format(p='doc_id, block_no', n='BLOCK')} AS block_status, CASE WHEN lead(page) OVER d <> page THEN 'PAGEEND' WHEN lag(page) OVER d IS DISTINCT FROM page THEN 'PAGESTART' ELSE 'PAGEIN' END AS page_status FROM ln WINDOW d AS (PARTITION BY doc_id ORDER BY line_no)")
def block_page_status(spark, d):
    rows = layout.status(layout.text_lines(table(spark, d, "documents")), ("doc_id", "block_no"), "line_no", "block_status", ("BLOCKSTART", "BLOCKIN", "BLOCKEND"))
    return layout.page_status(rows).select("doc_id", "line_no", "block_status", "page_status")


_PLACE = "CAST(least(floor(coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 12 / greatest(sum(length(line) + 1) OVER (PARTITION BY doc_id), 1)), 11) AS BIGINT)"
_LENGTH = "CAST(least(floor(length(line) * 10 / greatest(max(length(line)) OVER (PARTITION BY doc_id, block_no), 1)), 9) AS BIGINT)"


@query(f"WITH {LINES} SELECT doc_id, line_no, {_PLACE} AS relative_position, {_LENGTH} AS length_bin FROM ln")
def position_length_bins(spark, d):
    return layout.line_lengths(layout.positions(layout.text_lines(table(spark, d, "documents")))).select("doc_id", "line_no", "relative_position", "length_bin")


@query(rf"""WITH {LINES}, f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page, block_no ORDER BY line_no) AS r FROM ln), g AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY block_no) - 1 AS i, count(*) OVER (PARTITION BY doc_id, page) AS size FROM f WHERE r = 1),
h AS (SELECT doc_id, line_no, lower(regexp_replace(line, '[\s\p{{N}}]', '', 'g')) AS pattern FROM g WHERE i < 2 OR i > size - 2), k AS (SELECT *, count(*) OVER (PARTITION BY doc_id, pattern) AS n, row_number() OVER (PARTITION BY doc_id, pattern ORDER BY line_no) AS k FROM h WHERE length(pattern) > 8)
SELECT doc_id, line_no, pattern, n, CAST(k = 1 AS INTEGER) AS first FROM k WHERE n > 1""")
def repetitive_line(spark, d):
    return layout.repetitive(layout.text_lines(table(spark, d, "documents")))


LAYOUT = Literal(
    "doc_id bigint,token_no bigint,line_no bigint,zone string,text string,font string,font_size double,x double,width double",
    (1, 0, 0, "header", "Compte", "A", 14.0, 50.0, 60.0), (1, 1, 0, "header", "rendu", "A", 14.0, 115.0, 50.0), (1, 2, 1, "body", "Le", "B", 10.0, 50.0, 12.0), (1, 3, 2, "body", "patient", "B", 10.0, 70.0, 35.0), (1, 4, 3, "body", "va", "B", 12.0, 71.0, 12.0), (1, 5, 4, "body", "bien", "C", 9.0, 50.0, 24.0), (2, 0, 0, "body", "Seul", "A", 11.0, 10.0, 20.0),
)


@query(f"""SELECT doc_id, token_no, CASE WHEN lag(font) OVER w = font THEN 'SAMEFONT' ELSE 'NEWFONT' END AS font_status, CASE WHEN lag(CAST(font_size AS INTEGER)) OVER w IS NULL OR CAST(font_size AS INTEGER) > lag(CAST(font_size AS INTEGER)) OVER w THEN 'HIGHERFONT' WHEN CAST(font_size AS INTEGER) = lag(CAST(font_size AS INTEGER)) OVER w THEN 'SAMEFONTSIZE' ELSE 'LOWERFONT' END AS size_status,
 CAST(font_size = max(font_size) OVER z AS INTEGER) AS largest, CAST(font_size = min(font_size) OVER z AS INTEGER) AS smallest, CAST(font_size > avg(font_size) OVER z AS INTEGER) AS above_average FROM {LAYOUT.sql} WINDOW w AS (PARTITION BY doc_id ORDER BY token_no), z AS (PARTITION BY doc_id, zone)""")
def font_status(spark, d):
    return layout.fonts(LAYOUT.df(spark)).select("doc_id", "token_no", "font_status", "size_status", "largest", "smallest", "above_average")


@query(f"""WITH t AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line_no ORDER BY token_no) = 1 AS s FROM {LAYOUT.sql}), b AS (SELECT *, lag(x) OVER (PARTITION BY doc_id ORDER BY token_no) AS px, width / greatest(length(text), 1) AS w FROM t WHERE s), m AS (SELECT doc_id, token_no, CASE WHEN x - px > w THEN 'LINEINDENT' WHEN px - x > w THEN 'ALIGNEDLEFT' END AS moved FROM b)
SELECT t.doc_id, t.token_no, coalesce(last_value(moved IGNORE NULLS) OVER (PARTITION BY t.doc_id ORDER BY t.token_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'ALIGNEDLEFT') AS indentation FROM t LEFT JOIN m ON t.doc_id = m.doc_id AND t.token_no = m.token_no""")
def indentation(spark, d):
    return layout.indentation(LAYOUT.df(spark)).select("doc_id", "token_no", "indentation")


BLOCKS = Literal("doc_id bigint,block_no bigint,page bigint,text string,x double,y double,width double,height double", (1, 0, 0, "Titre", 50.0, 50.0, 200.0, 20.0), (1, 1, 0, "Un texte assez long pour la suite", 50.0, 80.0, 200.0, 40.0), (1, 2, 0, "@IMAGE x.png", 50.0, 110.0, 100.0, 10.0), (1, 3, 0, "pied", 50.0, 800.0, 100.0, 10.0), (1, 4, 1, "Suite", 60.0, 60.0, 80.0, 12.0))
PAGES = Literal("doc_id bigint,page bigint,mx double,my double,mw double,mh double", (1, 0, 40.0, 40.0, 500.0, 700.0), (1, 1, 40.0, 40.0, 500.0, 700.0))
GRAPHICS = Literal("doc_id bigint,page bigint,x double,y double,width double,height double", (1, 0, 50.0, 130.0, 100.0, 100.0), (1, 1, 400.0, 400.0, 10.0, 10.0))


@query(f"""WITH b AS (SELECT *, CASE WHEN lag(page) OVER w = page THEN y - lag(y + height) OVER w END AS gap, CASE WHEN NOT regexp_matches(text, '@IMAGE|@PAGE|\\.(pbm|ppm|png|svg|jpg)') AND height * width > 0 THEN length(text) / (height * width) END AS density FROM {BLOCKS.sql} WINDOW w AS (PARTITION BY doc_id ORDER BY block_no)),
c AS (SELECT *, max(CASE WHEN gap > 0 THEN gap END) OVER (PARTITION BY doc_id) AS mg, min(density) OVER (PARTITION BY doc_id) AS lo, max(density) OVER (PARTITION BY doc_id) AS hi FROM b)
SELECT c.doc_id, block_no, CAST(least(floor(CASE WHEN gap < 0 THEN mg / 5 ELSE coalesce(gap, 0) END * 5 / greatest(mg, 1)), 4) AS BIGINT) AS spacing_bin, CASE WHEN density IS NULL THEN 0 ELSE CAST(least(floor((density - lo) * 5 / greatest(CASE WHEN hi > lo THEN hi - lo ELSE 1.0 END, 1)), 4) AS BIGINT) END AS density_bin,
 CAST(x < mx + mw AND x + width > mx AND y < my + mh AND y + height > my AS INTEGER) AS in_main_area FROM c JOIN {PAGES.sql} p ON c.doc_id = p.doc_id AND c.page = p.page""")
def block_geometry(spark, d):
    pages = PAGES.df(spark).select("doc_id", "page", F.struct(F.col("mx").alias("x"), F.col("my").alias("y"), F.col("mw").alias("w"), F.col("mh").alias("h")).alias("main_area"))
    return layout.block_geometry(BLOCKS.df(spark), pages)


@query(f"SELECT DISTINCT b.doc_id, b.block_no FROM {BLOCKS.sql} b JOIN {GRAPHICS.sql} g ON b.doc_id = g.doc_id AND b.page = g.page AND g.x < b.x + b.width + 20 AND g.x + g.width > b.x - 20 AND g.y < b.y + b.height + 20 AND g.y + g.height > b.y - 20")
def graphics_near(spark, d):
    return layout.near_graphics(BLOCKS.df(spark), GRAPHICS.df(spark))


_HEAD = r"regexp_extract(line, '([^ \t\f\x{00A0}]+)', 1)"
_VEC = f"""tok || ' ' || coalesce(nullif(second, ''), 'no') || ' ' || concat_ws(' ', lower(tok), {", ".join(f"left(lower(tok), {n})" for n in range(1, 5))}, bs, ps, caps, digit, single, year, month, email, http, rp, CASE WHEN prof = '' THEN 'no' ELSE prof END, length(prof), lb)"""


@query(rf"""WITH {LINES}, v AS (SELECT doc_id, line_no, {_HEAD} AS tok, regexp_extract(line, '[^ \t\f\x{{00A0}}]+[ \t\f\x{{00A0}}]+([^ \t\f\x{{00A0}}]+)', 1) AS second, regexp_replace(line, '[^\p{{P}}]', '', 'g') AS prof, {_STATUS.format(p='doc_id, block_no', n='BLOCK')} AS bs, CASE WHEN lead(page) OVER d <> page THEN 'PAGEEND' WHEN lag(page) OVER d IS DISTINCT FROM page THEN 'PAGESTART' ELSE 'PAGEIN' END AS ps, {_PLACE} AS rp, {_LENGTH} AS lb FROM ln WINDOW d AS (PARTITION BY doc_id ORDER BY line_no)),
u AS (SELECT *, {_LEXICAL} FROM v) SELECT doc_id, line_no, {_VEC} AS features FROM u""")
def segmenter_vector(spark, d):
    return layout.segmenter_vector(layout.text_lines(table(spark, d, "documents")))


def _register_vectors() -> None:
    """One query a model over ``documents``: text lines are lines, each text one block."""
    for model in VECTORS:

        def run(spark, d, model=model):
            return vector(table(spark, d, "documents"), model)

        run.__name__ = f"vector_{model}"
        query(vector_sql(model))(run)


def vector_sql(model: str, swap: str = "", lexicon: tuple[str, ...] = (), before: str = "", terms: str = "") -> str:
    names = {
        "tok": "tok", "low": "lower(tok)", **{f"p{n}": f"left(lower(tok), {n})" for n in range(1, 6)}, **{f"s{n}": f"right(lower(tok), {n})" for n in range(1, 6)}, "caps": "caps", "digit": "digit", "single": "single", "punct": "punct", "shape": "shape", "trimmed": "trimmed",
        "year": "year", "month": "month", "email": "email", "http": "http", "line": "ls", "block": "bs", "position": "rp",
    }
    tokens, tk = before or TOKENS, "tk"
    if swap:
        tokens += f", sw AS (SELECT t.doc_id, t.pos, coalesce(m.pseudo, t.tok) AS tok, t.char_offset FROM tk t LEFT JOIN {swap} m ON t.doc_id = m.doc_id AND t.tok = m.original)"
        tk = "sw"
    cols = ", ".join(names[c] for c in VECTORS[model])
    source = "st"
    if lexicon:
        tokens += f", {terms or LEX_SQL}"
        cols += ", " + ", ".join(f"is_{c}" for c in lexicon)
        source = f"(SELECT s.*, {', '.join(f'(SELECT CAST(count(*) > 0 AS INTEGER) FROM lx l WHERE l.term_lower = lower(s.tok) AND l.class = {chr(39)}{c}{chr(39)}) AS is_{c}' for c in lexicon)} FROM st s)"
    return rf"""WITH {tokens}, nl AS (SELECT *, sum(CASE WHEN tok IN (chr(10), chr(13)) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS l, sum(length(tok)) OVER (PARTITION BY doc_id) AS total FROM {tk}),
so AS (SELECT * FROM nl WHERE NOT regexp_matches(tok, '^\s$')),
st AS (SELECT *, CASE WHEN row_number() OVER a = 1 THEN 'LINESTART' WHEN lead(1) OVER a IS NULL THEN 'LINEEND' ELSE 'LINEIN' END AS ls, CASE WHEN row_number() OVER b = 1 THEN 'BLOCKSTART' WHEN lead(1) OVER b IS NULL THEN 'BLOCKEND' ELSE 'BLOCKIN' END AS bs, CAST(least(floor(char_offset * 12 / greatest(total, 1)), 11) AS BIGINT) AS rp FROM so WINDOW a AS (PARTITION BY doc_id, l ORDER BY pos), b AS (PARTITION BY doc_id ORDER BY pos)),
u AS (SELECT *, {_LEXICAL} FROM {source}) SELECT doc_id, pos, concat_ws(' ', {cols}) AS features FROM u"""


_register_vectors()


@query(vector_sql("ner", lexicon=gazetteer.CLASSES))
def vector_lexicon_flags(spark, d):
    return vector(table(spark, d, "documents"), "ner", lex=gazetteer.lexicon(LEX.df(spark)))




KNOWN_TERMS = Literal(
    "term string,class string",
    ("The", "name"), ("de", "name"), ("and", "suffix"), ("der", "title"), ("la", "city"), ("que", "city"), ("in", "country"), ("is", "country"), ("una", "name"), ("der", "city"), (" ", "name"),
)
KNOWN_SQL = LEX_SQL.replace(LEX.sql, KNOWN_TERMS.sql)


def _register_known() -> None:
    """One query a model whose lines look up known names and places."""
    for model, classes in KNOWN_OF.items():

        def run(spark, d, model=model, classes=classes):
            return vector(table(spark, d, "documents"), model, lex=gazetteer.lexicon(KNOWN_TERMS.df(spark)), classes=classes)

        run.__name__ = f"known_{model}"
        query(vector_sql(model, lexicon=classes, terms=KNOWN_SQL))(run)


_register_known()
