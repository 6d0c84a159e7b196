"""Queries of clusters, records, XML, pseudonyms, scores and corpora."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import commands
from ..functions import pseudonym as P
from ..functions import text as T
from ..operators import assembly as A
from ..operators import corpus as C
from ..operators import documents as D
from ..operators import evaluation as E
from ..operators import extraction as X
from ..operators import flow, perceptron
from ..operators import pseudonymize as S
from ..operators import tokens as K
from ..operators.layout import text_lines
from ..operators.vectors import vector
from .queries_text import LABEL, LINES, TOKENS, vector_sql
from .registry import Literal, query, table
from .schema import ALIASES, FIELDS, ZONE_TAGS, fields_of

KEY = "demo"

# --- labelled tokens, clusters, tags

LABELED = Literal(
    "doc_id bigint,pos bigint,char_offset bigint,ws string,tok string,label string",
    (1, 0, 0, "", "Docteur", "I-title"), (1, 1, 8, " ", "Paul", "I-persname"), (1, 2, 13, " ", "Martin", "persname"), (1, 3, 19, "", ",", "other"), (1, 4, 21, " ", "Anne", "I-persname"), (1, 5, 26, " ", "<Roux>", "I-persname"), (1, 6, 33, "\n", "Lyon", "settlement"), (1, 7, 38, " ", "1", "marker"), (1, 8, 39, "", "er", "settlement"), (2, 0, 0, "", "Rien", "other"), (2, 1, 5, " ", "ici", "other"),
)


def labelled(spark, d):
    """Tokens of all documents with the labels of the entity rules."""
    return commands.entity_tokens(table(spark, d, "documents"))


_CL = f"""lt AS (SELECT * FROM {LABELED.sql}), pl AS (SELECT *, regexp_replace(label, '^I-', '') AS lab FROM lt),
ct AS (SELECT *, CAST(sum(CASE WHEN starts_with(label, 'I-') OR p IS NULL OR p <> lab THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS BIGINT) AS cluster_no FROM (SELECT *, lag(lab) OVER (PARTITION BY doc_id ORDER BY pos) AS p FROM pl))"""
_ESC = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')"


@query(f"WITH {TOKENS}, {LABEL} SELECT doc_id, cluster_no, label, string_agg(tok, ' ' ORDER BY pos) AS text FROM cl GROUP BY ALL")
def clusters(spark, d):
    return flow.clusters(table(spark, d, "documents"))


@query(f"WITH {TOKENS}, {LABEL} SELECT doc_id, label, string_agg(tok, ' ' ORDER BY pos) AS tokens FROM cl GROUP BY ALL")
def label_map(spark, d):
    return flow.label_map(table(spark, d, "documents"))


@query(f"WITH {_CL}, m AS (SELECT 'demo' AS model, lab AS label FROM ct) SELECT model, label, count(*) AS n FROM m GROUP BY ROLLUP (model, label)")
def label_counts(spark, d):
    return E.label_counts(K.cluster(LABELED.df(spark)).withColumn("model", F.lit("demo")))


TAGS = {"persname": "persName", "title": "roleName", "settlement": "settlement"}
_TAG = "CASE lab " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in TAGS.items()) + " END"


#: Runs of labelled tokens with the texts before and inside them.
_RUNS = f"""f AS (SELECT doc_id, cluster_no, label, min(char_offset) AS a, max(char_offset + length(tok)) AS b FROM cl GROUP BY ALL), p AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY cluster_no), 0) AS prev FROM f),
rn AS (SELECT doc_id, cluster_no, label, substr(text, CAST(prev + 1 AS BIGINT), CAST(a - prev AS BIGINT)) AS ld, {_ESC.format("substr(text, CAST(a + 1 AS BIGINT), CAST(b - a AS BIGINT))")} AS s FROM p JOIN documents USING (doc_id))"""


@query(f"WITH {TOKENS}, {LABEL}, {_RUNS} SELECT doc_id, string_agg(ld || CASE WHEN label = 'persname' THEN '<persName>' || s || '</persName>' ELSE s END, '' ORDER BY cluster_no) AS tagged FROM rn GROUP BY doc_id")
def inline_tags(spark, d):
    return flow.tagged(table(spark, d, "documents"), TAGS)


@query(f"WITH {TOKENS}, {LABEL}, {_RUNS} SELECT doc_id, md5(string_agg(ld || CASE WHEN label = 'other' THEN s ELSE '<' || label || '>' || s || '</' || label || '>' END, '' ORDER BY cluster_no)) AS tagged FROM rn GROUP BY doc_id")
def tagged_documents(spark, d):
    return flow.tagged(table(spark, d, "documents"), commands.ENTITY_TAGS).select("doc_id", F.md5("tagged").alias("tagged"))


@query(f"""WITH t AS (SELECT *, CASE WHEN lag(char_offset + length(tok)) OVER (PARTITION BY doc_id ORDER BY char_offset) IS DISTINCT FROM char_offset THEN 1 ELSE 0 END AS b FROM {LABELED.sql}), c AS (SELECT *, CAST(sum(b) OVER (PARTITION BY doc_id ORDER BY char_offset) AS BIGINT) AS chunk_no FROM t)
SELECT doc_id, chunk_no, CAST(min(char_offset) AS BIGINT) AS start, CAST(max(char_offset + length(tok)) AS BIGINT) AS "end", string_agg(tok, '' ORDER BY char_offset) AS text FROM c GROUP BY doc_id, chunk_no""")
def token_chunks(spark, d):
    return K.chunks(LABELED.df(spark))


@query(f"""WITH {TOKENS}, {LABEL}, t AS (SELECT *, label = 'persname' AS w FROM lb WHERE label <> 'value'), o AS (SELECT *, CASE WHEN w AND NOT coalesce(lag(w) OVER (PARTITION BY doc_id ORDER BY pos), false) THEN 1 ELSE 0 END AS o FROM t), c AS (SELECT *, CAST(sum(o) OVER (PARTITION BY doc_id ORDER BY pos) AS BIGINT) AS seq_no FROM o)
SELECT doc_id, seq_no, string_agg(tok, ' ' ORDER BY pos) AS text FROM c WHERE w GROUP BY doc_id, seq_no""")
def label_sequences(spark, d):
    return K.sequences(labelled(spark, d), ("persname",), ("value",))


NESTED = Literal(
    "doc_id bigint,pos bigint,ws string,tok string,label string,inner string",
    (1, 0, "", "CHU", "org", "x"), (1, 1, " ", "Dr", "I-medic", "rolename"), (1, 2, " ", "Paul", "medic", "persname"), (1, 3, " ", "<Roux>", "medic", "persname"), (1, 4, ",", "chef", "medic", "other"), (1, 5, "\n", "Dr", "I-medic", "rolename"), (1, 6, " ", "Anne", "medic", "persname"), (1, 7, " ", "Lyon", "other", "persname"), (2, 0, "", "Rien", "other", "other"),
)


@query(f"""WITH a AS (SELECT *, regexp_replace(label, '^I-', '') AS lab FROM {NESTED.sql}), b AS (SELECT *, CAST(starts_with(label, 'I-') OR lag(lab) OVER (PARTITION BY doc_id ORDER BY pos) IS DISTINCT FROM lab AS INT) AS o, CASE WHEN lab = 'medic' THEN "inner" ELSE 'other' END AS inn FROM a),
c AS (SELECT *, sum(o) OVER (PARTITION BY doc_id ORDER BY pos) AS oc FROM b), e AS (SELECT *, CAST(lag(inn) OVER (PARTITION BY doc_id, oc ORDER BY pos) IS DISTINCT FROM inn AS INT) AS io FROM c), f AS (SELECT *, sum(io) OVER (PARTITION BY doc_id, oc ORDER BY pos) AS ic FROM e),
g AS (SELECT doc_id, oc, lab, ic, inn, min_by(ws, pos) AS ld, string_agg(CASE WHEN io = 1 THEN '' ELSE ws END || {_ESC.format('tok')}, '' ORDER BY pos) AS x FROM f GROUP BY ALL),
h AS (SELECT *, CASE inn WHEN 'rolename' THEN '<roleName>' || x || '</roleName>' WHEN 'persname' THEN '<persName>' || x || '</persName>' ELSE x END AS y FROM g), k AS (SELECT doc_id, oc, lab, min_by(ld, ic) AS ld, string_agg(CASE WHEN ic = 1 THEN y ELSE ld || y END, '' ORDER BY ic) AS z FROM h GROUP BY ALL)
SELECT doc_id, string_agg(ld || CASE lab WHEN 'medic' THEN '<medic>' || z || '</medic>' WHEN 'org' THEN '<orgName>' || z || '</orgName>' ELSE z END, '' ORDER BY oc) AS tagged FROM k GROUP BY doc_id""")
def nested_tags(spark, d):
    return K.nested_tags(NESTED.df(spark), {"medic": "medic", "org": "orgName"}, "medic", {"rolename": "roleName", "persname": "persName"})


SWAPPED = Literal("doc_id bigint,kind string,original string,pseudo string", (1, "name", "Paul", "Louis"), (1, "name", "Martin", "Petit"), (1, "address", "Lyon", "Lille"), (2, "name", "Paul", "Zoé"))


@query("WITH " + _CL + ", v AS (SELECT c.*, coalesce(m.pseudo, c.tok) AS swapped FROM ct c LEFT JOIN " + SWAPPED.sql + " m ON c.doc_id = m.doc_id AND c.tok = m.original), w AS (SELECT *, min(pos) OVER (PARTITION BY doc_id, cluster_no) AS first FROM v), " + f"""
g AS (SELECT doc_id, cluster_no, lab, min_by(ws, pos) AS ld, string_agg(CASE WHEN pos = first THEN '' ELSE ws END || {_ESC.format('tok')}, '' ORDER BY pos) AS t, string_agg(CASE WHEN pos = first THEN '' ELSE ws END || {_ESC.format('swapped')}, '' ORDER BY pos) AS s FROM w GROUP BY ALL)
SELECT doc_id, 'demo' AS model, 'annotated' AS variant, string_agg(ld || CASE WHEN {_TAG} IS NULL THEN t ELSE '<' || {_TAG} || '>' || t || '</' || {_TAG} || '>' END, '' ORDER BY cluster_no) AS payload FROM g GROUP BY doc_id
UNION ALL SELECT doc_id, 'demo', 'pseudonymised', string_agg(ld || CASE WHEN {_TAG} IS NULL THEN s ELSE '<' || {_TAG} || '>' || s || '</' || {_TAG} || '>' END, '' ORDER BY cluster_no) FROM g GROUP BY doc_id
UNION ALL SELECT doc_id, 'demo', 'blank', string_agg(ld || t, '' ORDER BY cluster_no) FROM g GROUP BY doc_id""")
def training_rows(spark, d):
    return E.training_rows(LABELED.df(spark), SWAPPED.df(spark), TAGS, "demo")


ASKED = Literal("doc_id bigint,asked bigint", (1, 0), (1, 9), (1, 33), (1, 40), (2, 5))


@query(f"SELECT a.doc_id, asked, coalesce((SELECT min(pos) FROM {LABELED.sql} t WHERE t.doc_id = a.doc_id AND t.char_offset >= asked), -1) AS pos FROM {ASKED.sql} a")
def token_at_offset(spark, d):
    return K.token_at(LABELED.df(spark), ASKED.df(spark)).withColumn("pos", F.coalesce("pos", F.lit(-1)))


ZONED = Literal("doc_id bigint,cluster_no bigint,label string,text string", (1, 1, "titlePage", "Couverture"), (1, 2, "header", "CHU & co"), (1, 3, "headnote", "p. 1"), (1, 4, "body", "Texte"), (1, 5, "annex", "Suite"), (1, 6, "other", "reste"))
_ZT = "CASE label " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in ZONE_TAGS.items()) + " END"


@query(f"SELECT doc_id, string_agg(CASE WHEN {_ZT} IS NULL THEN {_ESC.format('text')} ELSE '<' || {_ZT} || '>' || {_ESC.format('text')} || '</' || split_part({_ZT}, ' ', 1) || '>' END, '' ORDER BY cluster_no) AS tagged FROM {ZONED.sql} GROUP BY doc_id")
def zone_tags(spark, d):
    return K.inline_tags(ZONED.df(spark).select("doc_id", F.col("cluster_no").alias("pos"), F.lit("").alias("ws"), F.col("text").alias("tok"), "label"), ZONE_TAGS)


@query(f"""WITH {LINES}, l AS (SELECT *, CASE WHEN row_number() OVER w <= 3 THEN 'header' WHEN lead(page) OVER w <> page AND length(line) < 60 THEN 'footnote' ELSE 'body' END AS label FROM ln WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)), z AS (SELECT *, CAST(sum(o) OVER (PARTITION BY doc_id ORDER BY line_no) AS BIGINT) AS zone_no FROM (SELECT *, CASE WHEN lag(label) OVER (PARTITION BY doc_id ORDER BY line_no) IS DISTINCT FROM label THEN 1 ELSE 0 END AS o FROM l))
SELECT doc_id, zone_no, label AS zone, min(line_no) AS line_start, max(line_no) AS line_end FROM z GROUP BY ALL""")
def document_zones(spark, d):
    return X.zones(X.label_zones(text_lines(table(spark, d, "documents"))))


@query(f"""WITH t AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\\S+')) FROM documents) GROUP BY 1), s AS (SELECT d.doc_id, coalesce(n, 0) AS n_tokens, CAST(1 AS BIGINT) AS n_blocks FROM documents d LEFT JOIN t USING (doc_id))
SELECT doc_id, 'segmenter' AS stage, CASE WHEN n_tokens = 0 THEN 'empty' ELSE 'too many tokens' END AS reason FROM s WHERE n_tokens = 0 OR n_tokens > 2000""")
def zone_rejects(spark, d):
    sizes = table(spark, d, "documents").select("doc_id", F.size(T.white_tokens(F.col("text"))).cast("long").alias("n_tokens"), F.lit(1).cast("long").alias("n_blocks"))
    return X.guard_zones(sizes, most_tokens=2000)[1]


# --- folds

FOLDS = {
    "header": Literal("doc_id bigint,cluster_no bigint,label string,text string", (1, 1, "docnum", "A12"), (1, 2, "docnum", "a 12"), (1, 3, "docnum", "B7"), (1, 4, "date", "7 mars"), (1, 5, "date", "7 mars 2019"), (1, 6, "time", "10h"), (1, 7, "time", "11h30"), (1, 8, "medic", "Dr A"), (1, 9, "medic", "Dr A"), (1, 10, "note", "x"), (1, 11, "note", "y"), (1, 12, "phone", "01"), (1, 13, "phone", "02"), (1, 14, "zzz", "?"), (2, 1, "title", "Compte rendu"), (2, 2, "title", " ")),
    "left_note": Literal("doc_id bigint,cluster_no bigint,label string,text string", (1, 1, "org", "CHU"), (1, 2, "org", "Pôle"), (1, 3, "phone", "01"), (1, 4, "medic", "Dr A")),
    "medic": Literal("doc_id bigint,cluster_no bigint,label string,text string", (1, 1, "rolename", "Chef"), (1, 2, "rolename", "Pr"), (1, 3, "persname", "A B"), (1, 4, "persname", "C D"), (1, 5, "center", "CHU"), (1, 6, "service", "Neuro"), (1, 7, "note", "x"), (1, 8, "note", "y"), (1, 9, "web", "w.fr")),
    "patient": Literal("doc_id bigint,cluster_no bigint,label string,text string", (1, 1, "idno", "1"), (1, 2, "idno", "2"), (1, 3, "idtype", "IPP"), (1, 4, "idtype", "NIP"), (1, 5, "persname", "A"), (1, 6, "persname", "B"), (1, 7, "phone", "01"), (1, 8, "phone", "0102"), (1, 9, "phone", "03"), (1, 10, "email", "a@b"), (1, 11, "email", "A@B")),
    "organization": Literal("doc_id bigint,cluster_no bigint,label string,text string", (1, 1, "orgname", "CHU"), (1, 2, "orgname", "Hôpital"), (1, 3, "settlement", "Lyon")),
    "address": Literal("doc_id bigint,cluster_no bigint,label string,text string", (1, 1, "streetnumber", "12"), (1, 2, "streetname", "rue A"), (1, 3, "postcode", "69000"), (1, 4, "city", "Lyon"), (1, 5, "city", "Cedex")),
    "person_name": Literal("doc_id bigint,cluster_no bigint,label string,text string", (1, 1, "title", "Dr"), (1, 2, "forename", "Paul"), (1, 3, "forename", "Jean"), (1, 4, "surname", "Martin")),
    "dateline": Literal("doc_id bigint,cluster_no bigint,label string,text string", (1, 1, "place", "Lyon"), (1, 2, "date", "7 mars 2019"), (1, 3, "date", "8 mars"), (1, 4, "note", "a"), (1, 5, "note", "b")),
    "entity": Literal("doc_id bigint,cluster_no bigint,label string,text string", (1, 1, "date", "7 mars"), (1, 2, "date", "8 mars"), (1, 3, "anatomy", "main")),
}


def fold_sql(model: str) -> str:
    """Ordered list a field, then the merge rule as a list reduction."""
    squeeze = lambda x: f"lower(replace({x}, ' ', ''))"
    out, rules = [], {f: r for _, f, r in FIELDS[model]}
    for field in fields_of(model):
        labels = ", ".join(f"'{a}'" for a, f, _ in FIELDS[model] if f == field)
        values = f"list(text ORDER BY cluster_no) FILTER (WHERE label IN ({labels}))"
        kind, _, sep = rules[field].partition(":")
        sep = sep.replace("\n", "'||chr(10)||'").replace("\t", "'||chr(9)||'")
        rule = {
            "join": f"array_to_string({values}, '{sep}')",
            "first": f"({values})[1]",
            "longest": f"list_reduce({values}, lambda a, x: CASE WHEN length(x) > length(a) THEN x ELSE a END)",
            "differ": f"list_reduce({values}, lambda a, x: CASE WHEN {squeeze('a')} = {squeeze('x')} THEN x ELSE a || '{sep}' || x END)",
            "shorter": f"list_reduce({values}, lambda a, x: CASE WHEN {squeeze('a')} <> {squeeze('x')} AND length(a) < length(x) THEN a || '{sep}' || x ELSE x END)",
        }[kind]
        out.append(f'{rule} AS "{field}"')
    known = ", ".join(f"'{a}'" for a, _, _ in FIELDS[model])
    return f"SELECT doc_id, {', '.join(out)} FROM {FOLDS[model].sql} WHERE trim(text) <> '' AND label IN ({known}) GROUP BY doc_id"


for _model in FOLDS:

    def _fold(spark, d, model=_model):
        return X.fold(FOLDS[model].df(spark), model)

    _fold.__name__ = f"{_model}_fold"
    query(fold_sql(_model))(_fold)


_MONTHS = "[" + ", ".join(f"'{m}'" for m in T.MONTHS) + "]"
HEADERS = Literal("doc_id bigint,doctype string,date string,medics string", (1, None, "7 mars 2019", "Dr A; Dr B;"), (2, "CR", None, None))
DATELINES = Literal("doc_id bigint,doctype string,place_name string,date string", (1, "Lettre", "Lyon", "8 mars 2019"), (2, "Lettre", "Paris", "01/02/2020"), (3, "Lettre", "Lille", "03.04.2021"), (4, "Note", None, None))


@query(f"""SELECT h.doc_id, coalesce(h.doctype, l.doctype) AS doctype, coalesce(h.date, l.date) AS date, place_name AS place, CASE WHEN regexp_matches(coalesce(h.date, l.date), '^[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}}$') THEN strftime(strptime(coalesce(h.date, l.date), '%d/%m/%Y'), '%Y-%m-%d') ELSE split_part(coalesce(h.date, l.date), ' ', 3) || '-' || lpad(CAST(list_position({_MONTHS}, split_part(coalesce(h.date, l.date), ' ', 2)) AS VARCHAR), 2, '0') || '-' || lpad(split_part(coalesce(h.date, l.date), ' ', 1), 2, '0') END AS iso_date,
 array_to_string(list_filter(list_transform(string_split(medics, ';'), lambda x: trim(x)), lambda x: x <> ''), '|') AS medic_list FROM {HEADERS.sql} h LEFT JOIN {DATELINES.sql} l ON h.doc_id = l.doc_id""")
def header_enrichment(spark, d):
    return X.enrich_header(HEADERS.df(spark), DATELINES.df(spark)).select("doc_id", "doctype", "date", "place", "iso_date", F.array_join("medic_list", "|").alias("medic_list"))


@query(f"SELECT doc_id, doctype, place_name, replace(date, '.', '/') AS date FROM {DATELINES.sql} WHERE date IS NOT NULL")
def dateline_sanity(spark, d):
    return X.sane_datelines(DATELINES.df(spark))


@query(f"SELECT doc_id FROM {HEADERS.sql} WHERE coalesce(doctype, medics) IS NOT NULL")
def not_empty_records(spark, d):
    return X.not_empty(HEADERS.df(spark), ["doctype", "medics"]).select("doc_id")


FIGURES = Literal("doc_id bigint,cluster_no bigint,label string,pos bigint,page bigint,block_no bigint,tok string", (1, 1, "figure", 0, 1, 4, " "), (1, 1, "figure", 1, 2, 5, "Figure"), (1, 1, "figure", 2, 2, 5, "1"), (1, 2, "table", 3, 2, 6, "Table"), (1, 3, "figure", 4, 3, 7, "Figure"), (1, 3, "figure", 5, 3, 8, "2"))


@query(f"""SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY cluster_no) AS BIGINT) AS id, page, blocks, text FROM (SELECT doc_id, cluster_no, min_by(page, pos) FILTER (WHERE trim(tok) <> '') AS page, array_to_string(list_sort(list(DISTINCT block_no)), ',') AS blocks, string_agg(tok, ' ' ORDER BY pos) AS text FROM {FIGURES.sql} WHERE label = 'figure' GROUP BY doc_id, cluster_no)""")
def figure_records(spark, d):
    return X.figures(FIGURES.df(spark), "figure")


MARKS = Literal("doc_id bigint,kind string,marker string,type string", (1, "figure", "(1)", "paren"), (1, "figure", "(1)", "paren"), (1, "figure", "[2]", "bracket"), (1, "figure", "[3]", "bracket"), (1, "table", "I", "roman"), (2, "table", "1", "arabic"), (2, "table", "I", "roman"))


@query(f"WITH c AS (SELECT doc_id, kind, type, count(*) AS n FROM (SELECT DISTINCT * FROM {MARKS.sql}) GROUP BY ALL) SELECT doc_id, kind, type, n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, kind ORDER BY n DESC, type) AS r FROM c) WHERE r = 1")
def marker_majority(spark, d):
    return X.majority_markers(MARKS.df(spark))


NAMES = Literal("doc_id bigint,title string,first_name string,middle_name string,last_name string,suffix string", (1, None, "Paul", None, "Martin", None), (1, "Dr", "P", None, "MARTIN", None), (1, None, None, None, "Martin", None), (1, None, "Anne", None, "Roux", None), (1, None, "Bernard", None, "Roux", None), (1, "Pr", None, None, "Roux", None), (1, None, "X", None, " ", None), (2, None, "Paul", "J", "Martin", "fils"))


@query(f"""WITH s AS (SELECT *, lower(last_name) AS k, lower(substr(coalesce(first_name, ''), 1, 1)) AS i FROM {NAMES.sql} WHERE trim(last_name) <> ''), n AS (SELECT doc_id, k, count(DISTINCT i) AS n, min(i) AS sole FROM s WHERE i <> '' GROUP BY ALL), g AS (SELECT s.*, CASE WHEN i = '' AND n = 1 THEN sole ELSE i END AS j FROM s LEFT JOIN n ON s.doc_id = n.doc_id AND s.k = n.k)
SELECT doc_id, {", ".join(f"max_by({f}, struct_pack(k := length({f}), v := {f})) FILTER (WHERE {f} IS NOT NULL) AS {f}" for f in ("title", "first_name", "middle_name", "last_name", "suffix"))}, count(*) AS mentions FROM g GROUP BY doc_id, k, j""")
def person_dedup(spark, d):
    return X.dedupe_names(X.sane_names(NAMES.df(spark)))


@query(f"""WITH {TOKENS}, {LABEL}, o AS (SELECT doc_id, offset_start, offset_end, min_by(struct_pack(t := type, r := raw_name), type) AS e FROM en GROUP BY ALL) SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY offset_start, offset_end) AS BIGINT) AS entity_no, offset_start, offset_end, e.t AS type, e.r AS raw_name FROM o""")
def entity_order(spark, d):
    return X.ordered_entities(K.entities(table(spark, d, "documents")))


def _by_line(sql: str) -> str:
    return sql.replace("FROM documents", "FROM ldocs").replace("JOIN documents", "JOIN ldocs")


@query(f"""WITH {LINES}, ldocs AS (SELECT doc_id * 1000000 + line_no AS doc_id, line AS text FROM el WHERE trim(line) <> ''), {_by_line(TOKENS)}, {_by_line(LABEL)} SELECT doc_id // 1000000 AS doc_id, doc_id % 1000000 AS line_no, type, offset_start, offset_end, raw_name FROM en""")
def body_entities(spark, d):
    return X.body_entities(table(spark, d, "documents"))


# --- XML

MEDICS = Literal("doc_id bigint,block_no bigint,idno string,role string,pers_name string,affiliation string,org_name string,institution string,address string,country string,town string,email string,phone string,fax string,web string,note string", (1, 1, None, "Pr\tChef", "A & B", None, "CHU", None, None, None, "Lyon", None, "01", None, None, None), (1, 0, "77", None, "C", None, None, None, None, None, None, "c@d.fr", None, None, None, None), (2, 0, None, None, None, None, None, None, None, None, None, None, None, None, None, None))
PATIENTS = Literal("doc_id bigint,block_no bigint,id string,id_type string,pers_name string,sex string,birth string,birth_place string,age string,death string,address string,country string,town string,phone string,email string,note string", (1, 0, "1; 2", "IPP", "D <E>", "F", "01/02/1950", None, None, None, None, None, None, None, None, None))
DLINES = Literal("doc_id bigint,block_no bigint,doctype string,place_name string,date string,time_string string,note string", (1, 0, "Lettre", "Lyon", "7 mars 2019", None, None))
PEOPLE = Literal("doc_id bigint,block_no bigint,title string,first_name string,middle_name string,last_name string,suffix string", (1, 0, "Dr", "Paul", None, "Martin", None))


def element_sql(tag: str, col: str, attributes: str = "") -> str:
    head = f"{tag} {attributes}" if attributes else tag
    return f"CASE WHEN {col} IS NOT NULL AND {col} <> '' THEN '<{head}>' || {_ESC.format(col)} || '</{tag}>' ELSE '' END"


def fragment_sql(model: str) -> str:
    inner = " || ".join(element_sql(t, f, a) for f, t, a in A.FRAGMENTS[model])
    root = A.ROOTS[model]
    return f"CASE WHEN {inner} <> '' THEN '<{root}>' || {inner} || '</{root}>' ELSE '' END"


for _model, _rows in (("medic", MEDICS), ("patient", PATIENTS), ("dateline", DLINES), ("person_name", PEOPLE)):

    def _xml(spark, d, model=_model, rows=_rows):
        return A.people_list(rows.df(spark), model)

    _xml.__name__ = f"{_model}_xml"
    query(f"""SELECT doc_id, '<listPerson type="{_model}">' || string_agg(x, '' ORDER BY block_no) || '</listPerson>' AS xml FROM (SELECT doc_id, block_no, {fragment_sql(_model)} AS x FROM {_rows.sql}) WHERE x <> '' GROUP BY doc_id""")(_xml)


HEADER_ROWS = Literal("doc_id bigint,docnum string,title string,date string,time string,affiliation string,address string,org string,email string,phone string,fax string,web string,doctype string,note string", (1, "A12", "Compte < rendu", "2019-03-07", None, None, "1 rue A", "CHU", None, "01", None, None, "CR", None), (2, None, None, None, None, None, None, None, None, None, None, None, "Lettre", None))
_PUB = " || ".join([element_sql(t, c) for t, c in (("orgName", "org"), ("affiliation", "affiliation"), ("address", "address"), ("email", "email"), ("phone", "phone"), ("fax", "fax"), ("ptr", "web"), ("date", "date"), ("time", "time"), ("idno", "docnum"), ("note", "note"))])


@query(f"""SELECT doc_id, '<teiHeader><encodingDesc><appInfo when="T0"/></encodingDesc><fileDesc><titleStmt>' || {element_sql("title", "coalesce(title, doctype)", 'level="a" type="main"')} || '</titleStmt>' || CASE WHEN coalesce({", ".join(A.PUBLICATION)}) IS NOT NULL THEN '<publicationStmt>' || {_PUB} || '</publicationStmt>' ELSE '<publicationStmt><publisher/></publicationStmt>' END || '<sourceDesc></sourceDesc></fileDesc></teiHeader>' AS xml FROM {HEADER_ROWS.sql}""")
def header_xml(spark, d):
    return HEADER_ROWS.df(spark).select("doc_id", A.header_xml(stamp="T0").alias("xml"))


LEFT = Literal("doc_id bigint,idno string,affiliation string,org string,address string,country string,settlement string,phone string,fax string,email string,web string,medic string,note string", (1, None, None, "CHU\nPôle", None, None, "Lyon", "01", None, None, None, "Dr A", None))
_LEFT = " || ".join(element_sql(t, c) for t, c in (("orgName", "org"), ("affiliation", "affiliation"), ("idno", "idno"), ("address", "address"), ("country", "country"), ("settlement", "settlement"), ("phone", "phone"), ("fax", "fax"), ("email", "email"), ("ptr", "web"), ("medic", "medic"), ("note", "note")))


@query(f"SELECT doc_id, '<org>' || {_LEFT} || '</org>' AS xml FROM {LEFT.sql}")
def left_note_xml(spark, d):
    return LEFT.df(spark).select("doc_id", A.left_note_xml().alias("xml"))


BODY = Literal("doc_id bigint,cluster_no bigint,label string,text string", (1, 1, "paragraph", "Avant  tout"), (1, 2, "section", "1.2 Motif"), (1, 3, "paragraph", "Le pa-\ntient va"), (1, 4, "figure_marker", "Figure 1"), (1, 5, "paragraph", "bien."), (1, 6, "item", "un"), (1, 7, "item", "deux"), (1, 8, "paragraph", "Fin"), (1, 9, "paragraph", "Autre"), (1, 10, "subsection", "Suite"), (1, 11, "note", "n & m"), (2, 1, "title", "Seul"))


@query(f"""WITH b AS (SELECT *, label IN ('title', 'section', 'subsection') AS h, label IN ('figure_marker', 'table_marker') AS m, lag(label) OVER (PARTITION BY doc_id ORDER BY cluster_no) AS p, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS n0, trim(regexp_replace(regexp_replace(text, '(\\p{{L}})-[ \\t]*\\r?\\n[ \\t]*(\\p{{Ll}})', '\\1\\2', 'g'), '\\s+', ' ', 'g')) AS t0 FROM {BODY.sql}),
c AS (SELECT *, CASE WHEN m THEN 'paragraph' ELSE label END AS kind, coalesce(((label = 'paragraph' OR m) AND (p IN ('figure_marker', 'table_marker') OR (m AND p = 'paragraph'))) OR (label = 'item' AND p = 'item'), false) AS j, regexp_extract(n0, '^(\\d+(?:\\.\\d+)*\\.?)\\s+(.*)$', 1) AS num FROM b),
e AS (SELECT *, sum(CAST(h AS INT)) OVER w AS dv, sum(CAST(NOT j AS INT)) OVER w AS run, CASE WHEN h THEN '<head' || CASE label WHEN 'section' THEN ' level="1"' WHEN 'subsection' THEN ' level="2"' ELSE '' END || CASE WHEN num <> '' THEN ' n="' || num || '"' ELSE '' END || '>' || {_ESC.format("CASE WHEN num <> '' THEN regexp_extract(n0, '^\\S+\\s+(.*)$', 1) ELSE n0 END")} || '</head>' WHEN m THEN '<ref type="' || replace(label, '_marker', '') || '">' || {_ESC.format('t0')} || '</ref>' WHEN label = 'item' THEN '<item>' || {_ESC.format('t0')} || '</item>' ELSE {_ESC.format('t0')} END AS x FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY cluster_no)),
f AS (SELECT doc_id, dv, run, min_by(kind, cluster_no) AS kind, string_agg(x, ' ' ORDER BY cluster_no) AS x, bool_or(h) AS h FROM e GROUP BY ALL), g AS (SELECT doc_id, dv, string_agg(CASE WHEN h THEN x WHEN kind = 'paragraph' THEN '<p>' || x || '</p>' WHEN kind = 'item' THEN '<list>' || x || '</list>' ELSE '<' || kind || '>' || x || '</' || kind || '>' END, '' ORDER BY run) AS x FROM f GROUP BY ALL)
SELECT doc_id, '<body>' || string_agg('<div>' || x || '</div>', '' ORDER BY dv) || '</body>' AS body FROM g WHERE x <> '' GROUP BY doc_id""")
def body_divs(spark, d):
    return A.body_xml(BODY.df(spark))


CALLS = Literal("doc_id bigint,marker_no bigint,text string", (1, 1, "voir Figure 1 et Table 2"), (1, 2, "figure 12"), (1, 3, "rien"), (2, 1, "Figure 1"))
TARGETS = Literal("doc_id bigint,id bigint,label string", (1, 1, "Figure 1"), (1, 2, "Table 2"), (1, 3, ""), (2, 5, "Table 9"))


@query(f"SELECT c.doc_id, c.marker_no, coalesce(min(t.id), -1) AS target FROM {CALLS.sql} c LEFT JOIN {TARGETS.sql} t ON c.doc_id = t.doc_id AND t.label <> '' AND contains(lower(c.text), lower(t.label)) GROUP BY ALL")
def reference_resolution(spark, d):
    return A.resolve_references(CALLS.df(spark), TARGETS.df(spark)).withColumn("target", F.coalesce("target", F.lit(-1)))


NOTES = Literal("doc_id bigint,note_no bigint,text string", (1, 1, "1 Voir la lettre"), (1, 2, "court"), (1, 3, "1 Voir la  lettre"), (1, 4, "Hospi-\ntalisation"), (2, 1, "12 Autre note"))


@query(rf"""WITH n AS (SELECT doc_id, note_no, trim(regexp_replace(regexp_replace(text, '(\p{{L}})-[ \t]*\r?\n[ \t]*(\p{{Ll}})', '\1\2', 'g'), '\s+', ' ', 'g')) AS t FROM {NOTES.sql}), m AS (SELECT doc_id, t, min(note_no) AS note_no FROM n WHERE length(t) >= 6 GROUP BY ALL)
SELECT doc_id, note_no, regexp_extract(t, '^(\d+)(.*)', 1) AS number, trim(CASE WHEN regexp_matches(t, '^\d+') THEN regexp_extract(t, '^(\d+)(.*)', 2) ELSE t END) AS text FROM m""")
def note_records(spark, d):
    return A.notes(NOTES.df(spark))


SIZES = Literal("doc_id bigint,page bigint,width double,height double", (1, 2, 595.5, 842.0), (1, 1, 595.5, 842.0))


@query(f"""SELECT doc_id, '<facsimile>' || string_agg('<surface n="' || page || '" ulx="0.0" uly="0.0" lrx="' || width || '" lry="' || height || '"/>', '' ORDER BY page) || '</facsimile>' AS xml FROM {SIZES.sql} GROUP BY doc_id""")
def facsimile(spark, d):
    return A.facsimile(SIZES.df(spark))


@query(f"WITH {LINES} SELECT doc_id, line_no, '_' || substr(sha256(doc_id || '|' || line_no), 1, 7) AS element_id FROM ln")
def element_ids(spark, d):
    """An id for each line of the documents."""
    return text_lines(table(spark, d, "documents")).select("doc_id", "line_no", A.element_id(F.col("doc_id"), F.col("line_no")).alias("element_id"))


@query(f"""WITH {TOKENS}, {LABEL} SELECT doc_id, '<entities>' || string_agg('<entity type="' || type || '" start="' || offset_start || '" end="' || offset_end || '">' || {_ESC.format('raw_name')} || '</entity>', '' ORDER BY offset_start) || '</entities>' AS xml FROM en GROUP BY doc_id""")
def entities_xml(spark, d):
    return A.entities_xml(K.entities(table(spark, d, "documents")))


BOXES = Literal("doc_id bigint,page bigint,x double,y double,w double,h double", (1, 1, 10.0, 20.5, 30.25, 4.0), (1, 2, 1.5, 2.5, 3.5, 4.5))


@query(f"SELECT doc_id, string_agg(page || ',' || printf('%.2f', x) || ',' || printf('%.2f', y) || ',' || printf('%.2f', w) || ',' || printf('%.2f', h), ';' ORDER BY page) AS coords FROM {BOXES.sql} GROUP BY doc_id")
def coordinates(spark, d):
    return BOXES.df(spark).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "x", "y", "w", "h"))).alias("b")).select("doc_id", A.coordinates(F.col("b")).alias("coords"))


STRING_ROWS = Literal("doc_id bigint,text string", (1, "Docteur Paul MARTIN 0102030405 paul@chu.fr"), (2, "Pr Anne Roux, chef"), (3, "rien"))


@query(f"""WITH w AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}|\\p{{L}}+|\\p{{N}}+|[^\\p{{L}}\\p{{N}}]') AS t FROM {STRING_ROWS.sql}), e AS (SELECT doc_id, CAST(generate_subscripts(t, 1) AS BIGINT) AS pos, unnest(t) AS tok FROM w), s AS (SELECT * FROM e WHERE trim(tok) <> ''),
l AS (SELECT *, CASE WHEN lower(tok) IN ('docteur', 'dr', 'professeur', 'pr', 'chef', 'interne') THEN 'role' WHEN contains(tok, '@') AND length(tok) > 1 THEN 'email' WHEN regexp_matches(tok, '^\\p{{N}}+$') THEN 'phone' WHEN regexp_matches(tok, '^\\p{{Lu}}\\p{{L}}+$') THEN 'pers_name' ELSE 'other' END AS lab FROM s),
b AS (SELECT *, CASE WHEN lag(lab) OVER (PARTITION BY doc_id ORDER BY pos) IS DISTINCT FROM lab THEN 1 ELSE 0 END AS o FROM l), c AS (SELECT *, sum(o) OVER (PARTITION BY doc_id ORDER BY pos) AS cl FROM b), g AS (SELECT doc_id, cl, lab, string_agg(tok, ' ' ORDER BY pos) AS x FROM c WHERE lab <> 'other' GROUP BY ALL),
r AS (SELECT doc_id, string_agg(x, chr(9) ORDER BY cl) FILTER (WHERE lab = 'role') AS role, string_agg(x, '; ' ORDER BY cl) FILTER (WHERE lab = 'pers_name') AS pers_name, string_agg(x, '; ' ORDER BY cl) FILTER (WHERE lab = 'email') AS email, string_agg(x, '; ' ORDER BY cl) FILTER (WHERE lab = 'phone') AS phone FROM g GROUP BY doc_id)
SELECT doc_id, '<medic>' || {element_sql("roleName", "role")} || {element_sql("persName", "pers_name")} || {element_sql("email", "email")} || {element_sql("phone", "phone")} || '</medic>' AS xml FROM r""")
def medic_strings(spark, d):
    return D.string_records(STRING_ROWS.df(spark), "medic")


@query()
def full_documents(spark, d):
    """Header, body and notes of all documents as XML."""
    return D.full_documents(table(spark, d, "documents"), stamp="T0")


_LEFT = "CASE " + " ".join(f"WHEN regexp_matches(line, '{p}') THEN '{n}'" for n, p in D.LEFT_NOTE) + " END"


@query(f"WITH {LINES} SELECT * FROM (SELECT doc_id, line_no AS cluster_no, {_LEFT} AS label, trim(line) AS text FROM ln WHERE page BETWEEN 0 AND 2) WHERE label IS NOT NULL")
def left_note_lines(spark, d):
    return D.left_note_lines(table(spark, d, "documents"))


_LEFT_TAGS = {"org": "orgName", "idno": "idno", "address": "address", "phone": "phone", "fax": "fax", "email": "email", "web": "ptr", "medic": "medic"}
_LEFT_XML = " || ".join(f"coalesce('<{t}>' || string_agg({_ESC.format('text')}, chr(10) ORDER BY cluster_no) FILTER (WHERE label = '{n}') || '</{t}>', '')" for n, t in _LEFT_TAGS.items())


@query(f"WITH {LINES}, l AS (SELECT doc_id, line_no AS cluster_no, {_LEFT} AS label, trim(line) AS text FROM ln WHERE page BETWEEN 0 AND 2) SELECT doc_id, '<org>' || {_LEFT_XML} || '</org>' AS xml FROM l WHERE label IS NOT NULL GROUP BY doc_id")
def left_note_documents(spark, d):
    """The left note of all documents that have one."""
    return D.left_note_documents(table(spark, d, "documents"))


_BACK = "CASE " + " ".join(f"WHEN label = 'body' AND regexp_matches(line, '{p}') THEN '{n}'" for n, p in D.BACK) + " END"


@query(f"""WITH {LINES}, z AS (SELECT *, row_number() OVER w AS r, coalesce(lead(page) OVER w <> page, false) AS last FROM ln WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
y AS (SELECT *, CASE WHEN r <= 3 THEN 'header' WHEN last AND length(line) < 60 THEN 'footnote' ELSE 'body' END AS label FROM z), x AS (SELECT *, {_BACK} AS opens FROM y),
v AS (SELECT *, last_value(opens IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no) AS since FROM x) SELECT doc_id, line_no, CASE WHEN label = 'body' AND since IS NOT NULL THEN since ELSE label END AS label FROM v""")
def line_zones(spark, d):
    """The zone of each line, back matter included."""
    return D.back_zones(D.zoned_lines(table(spark, d, "documents"))).select("doc_id", "line_no", "label")


# --- pseudonyms


def pick_sql(value: str, counter: str, n: int) -> str:
    return f"(CAST('0x' || substr(md5('{KEY}|' || {value} || '|' || {counter}), 1, 8) AS BIGINT) % {n})"


_NAMES = "[" + ", ".join(f"'{n}'" for n in P.NAMES) + "]"


def number_sql(value: str) -> str:
    return f"array_to_string(list_transform(string_split({value}, ''), lambda c, i: CASE WHEN regexp_matches(c, '^[0-9]$') THEN CAST((CAST(c AS INTEGER) + 1 + {pick_sql(value, 'CAST(i - 1 AS VARCHAR)', 9)}) % 10 AS VARCHAR) ELSE c END), '')"


def name_sql(value: str) -> str:
    new = f"{_NAMES}[{pick_sql('lower(w)', "'0'", len(P.NAMES))} + 1]"
    return f"array_to_string(list_transform(string_split({value}, ' '), lambda w: CASE WHEN regexp_matches(w, '^\\p{{Lu}}{{2,}}$') THEN upper({new}) ELSE {new} END), ' ')"


def email_sql(value: str) -> str:
    new = f"lower({_NAMES}[{pick_sql('lower(p)', "'0'", len(P.NAMES))} + 1])"
    return f"array_to_string(list_transform(string_split(string_split({value}, '@')[1], '.'), lambda p: {new}), '.') || '@' || string_split({value}, '@')[2]"


PERSONAL = Literal("doc_id bigint,kind string,original string", (1, "idno", "AB-12 34"), (1, "name", "Paul MARTIN"), (1, "email", "paul.martin@chu.fr"), (1, "date", "2019-03-07"), (1, "date", "07/03/2019"), (1, "phone", "01 02 03"), (2, "name", "Paul"), (2, "date", "hier"), (2, "date", "7 mars 2019"), (2, "date", "1  Août 1999"), (2, "date", "7 mai-juin 2019"), (3, "date", "07/03/19"), (3, "date", "7-3-19"), (3, "date", "1er août 1999"), (3, "date", "7 mars 19"))
_SHIFT = f"CAST(CAST(TRY_CAST(original AS DATE) - CAST({pick_sql('original', "'0'", 3650)} + 1 AS INTEGER) AS DATE) AS VARCHAR)"
_LONG_YEAR = f"(1920 + {pick_sql('original', "'3'", 100)})"
_DAY, _MONTH = f"lpad(CAST({pick_sql('original', "'1'", 28)} + 1 AS VARCHAR), 2, '0')", f"lpad(CAST({pick_sql('original', "'2'", 12)} + 1 AS VARCHAR), 2, '0')"
_SHAPED, _NAMED = r"^(\d{1,2})([/.-])(\d{1,2})([/.-])(\d{4}|\d{2})$", r"^(\d{1,2})(?:er)?(\s+)(\p{L}+)(\s+)(\d{4}|\d{2})$"


def _year_sql(pattern: str) -> str:
    return f"CASE WHEN length(regexp_extract(original, '{pattern}', 5)) = 2 THEN lpad(CAST({_LONG_YEAR} % 100 AS VARCHAR), 2, '0') ELSE CAST({_LONG_YEAR} AS VARCHAR) END"


_MONTH_LIST = ", ".join(f"'{m}'" for m in T.MONTHS)
_RAW = f"""CASE WHEN regexp_matches(original, '{_SHAPED}') THEN {_DAY} || regexp_extract(original, '{_SHAPED}', 2) || {_MONTH} || regexp_extract(original, '{_SHAPED}', 4) || {_year_sql(_SHAPED)}
 WHEN lower(regexp_extract(original, '{_NAMED}', 3)) IN ({_MONTH_LIST}) THEN {_DAY} || regexp_extract(original, '{_NAMED}', 2) || {_MONTHS}[{pick_sql('original', "'2'", 12)} + 1] || regexp_extract(original, '{_NAMED}', 4) || {_year_sql(_NAMED)} ELSE {number_sql('original')} END"""
_PSEUDO = f"CASE kind WHEN 'name' THEN {name_sql('original')} WHEN 'email' THEN {email_sql('original')} WHEN 'date' THEN CASE WHEN regexp_matches(original, '^\\d{{4}}-') THEN {_SHIFT} ELSE {_RAW} END ELSE {number_sql('original')} END"


#: Personal data of all documents with their pseudonyms, from the entities. Names have no dates among them.
_FOUND = f"""fo AS (SELECT DISTINCT doc_id, CASE type WHEN 'persname' THEN 'name' ELSE type END AS kind, trim(regexp_replace(raw_name, '\\s+', ' ', 'g')) AS original FROM en WHERE type IN ('persname', 'idno', 'email'))"""
_PAIRED = f"""{TOKENS}, {LABEL}, {_FOUND}, pd AS (SELECT doc_id, kind, original, CASE kind WHEN 'name' THEN {name_sql('original')} WHEN 'email' THEN {email_sql('original')} ELSE {number_sql('original')} END AS pseudo FROM fo)"""


@query(f"WITH {_PAIRED} SELECT * FROM pd")
def pseudonyms(spark, d):
    return commands.pairs(table(spark, d, "documents"), KEY)


@query(f"SELECT doc_id, {number_sql('CAST(doc_id AS VARCHAR)')} AS masked FROM documents")
def mask_number(spark, d):
    return table(spark, d, "documents").select("doc_id", P.mask_number(F.col("doc_id").cast("string"), KEY).alias("masked"))


_MAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


@query(f"SELECT doc_id, e, {email_sql('e')} AS masked FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{_MAIL}')) AS e FROM documents)")
def mask_email(spark, d):
    return table(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(_MAIL), 0)).alias("e")).withColumn("masked", P.mask_email(F.col("e"), KEY))


RECORDS = Literal("doc_id bigint,pers_name string,idno string,phone string,email string,date string", (1, "Paul Martin; Dr. X; Al", "*123*; 4", "01 02\t03", "a@b.fr", None), (1, "Paul Martin", None, None, None, "2019-03-07"))


@query(f"""WITH {TOKENS}, {LABEL}, e AS (SELECT DISTINCT doc_id, CASE type WHEN 'persname' THEN 'name' ELSE type END AS kind, trim(raw_name) AS original FROM en WHERE type IN ('persname', 'idno', 'email'))
SELECT * FROM e WHERE CASE kind WHEN 'idno' THEN length(original) > 1 WHEN 'name' THEN length(original) > 2 AND NOT contains(original, '.') ELSE length(original) > 0 END""")
def collect_identifiers(spark, d):
    of = lambda kind: F.when(F.col("type") == kind, F.col("raw_name"))
    rows = K.entities(table(spark, d, "documents")).select("doc_id", of("persname").alias("pers_name"), of("idno").alias("idno"), of("email").alias("email"))
    return S.collect(rows, ["pers_name", "idno", "email"])


_SOLID = "list_filter(regexp_extract_all({}, '\\p{{L}}+|\\p{{N}}+|[^\\p{{L}}\\p{{N}}]'), lambda t: regexp_matches(t, '^[\\p{{L}}\\p{{N}}]'))"
_PARTS = f"""z AS (SELECT doc_id, kind, {_SOLID.format('original')} AS o, {_SOLID.format('pseudo')} AS q FROM pd), y AS (SELECT doc_id, kind, o[i] AS original, q[i] AS pseudo FROM (SELECT *, unnest(range(1, least(len(o), len(q)) + 1)) AS i FROM z)),
cp AS (SELECT doc_id, kind, original, pseudo FROM pd UNION ALL SELECT * FROM y WHERE length(original) > CASE WHEN kind = 'name' THEN 2 ELSE 1 END)"""


@query(f"WITH {_PAIRED}, {_PARTS} SELECT * FROM cp")
def pseudonym_components(spark, d):
    return S.components(commands.pairs(table(spark, d, "documents"), KEY))


PAIRS = Literal("doc_id bigint,kind string,original string,pseudo string", (1, "name", "Paul", "Louis"), (1, "address", "Paul", "Zoé"), (1, "idno", "123", "987"), (1, "date", "07/03/2019", "01/01/1990"), (2, "name", "le roux", "du pont"))
_INIT = "array_to_string(list_transform(string_split({}, ' '), lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ')"
def map_sql(source: str) -> str:
    """CTEs up to mp, the map of pseudonyms from the pairs of ``source``."""
    return f"""o AS (SELECT doc_id, kind, original, pseudo FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, original ORDER BY kind, pseudo) AS r FROM {source}) WHERE r = 1),
v AS (SELECT doc_id, kind, 0 AS k, original, pseudo FROM o UNION ALL SELECT doc_id, kind, k, CASE k WHEN 1 THEN upper(replace(original, 'ß', 'SS')) WHEN 2 THEN lower(original) ELSE {_INIT.format('original')} END, CASE k WHEN 1 THEN upper(replace(pseudo, 'ß', 'SS')) WHEN 2 THEN lower(pseudo) ELSE {_INIT.format('pseudo')} END FROM o, (VALUES (1), (2), (3)) AS n(k) WHERE NOT regexp_matches(original, '^[0-9/.-]+$|^\\p{{N}}+$')),
mp AS (SELECT doc_id, kind, original, pseudo FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, original ORDER BY k, kind, pseudo) AS r FROM v) WHERE r = 1)"""


_MAPPED = f"{_PAIRED}, {_PARTS}, {map_sql('cp')}"


@query(f"WITH {_MAPPED} SELECT * FROM mp")
def pseudonym_table(spark, d):
    return commands.pseudonyms(table(spark, d, "documents"), KEY)


@query(f"WITH {_MAPPED} SELECT doc_id, string_agg(original || chr(9) || pseudo, chr(10) ORDER BY kind, original) AS tsv FROM mp GROUP BY doc_id")
def pseudonym_tsv(spark, d):
    return S.tsv(commands.pseudonyms(table(spark, d, "documents"), KEY))


@query(f"WITH {_MAPPED} SELECT t.doc_id, count(*) AS tokens, CAST(count(pseudo) AS BIGINT) AS replaced, md5(string_agg(coalesce(pseudo, tok), '' ORDER BY pos)) AS text FROM tk t LEFT JOIN mp m ON t.doc_id = m.doc_id AND t.tok = m.original GROUP BY t.doc_id")
def apply_map(spark, d):
    return flow.swapped_texts(table(spark, d, "documents"), KEY, originals=False).select("doc_id", "tokens", "replaced", F.md5("text").alias("text"))


@query(vector_sql("medic", swap="mp", before=_MAPPED))
def vector_pseudonymised(spark, d):
    """Tokens are swapped before features are derived, so that no feature shows the original."""
    return vector(table(spark, d, "documents"), "medic", key=KEY)


@query("SELECT CAST(NULL AS BIGINT) AS doc_id, '' AS original WHERE false")
def survivors(spark, d):
    """Originals that still stand in the texts once the map was applied to them: none."""
    # a pseudonym of one value may be the original of another of its document
    texts = flow.swapped_texts(table(spark, d, "documents"), KEY)
    left = F.array_intersect(F.regexp_extract_all("text", F.lit(T.PLAIN_TOKEN), 0), "originals")
    return texts.select("doc_id", F.explode_outer(left).alias("original")).where("original is not null")


ADDRESSES = Literal("doc_id bigint,address string", (1, "12 rue A 69001 Lyon"), (2, "7 bd B 75001 Paris"), (3, "sans code"))
CITIES = Literal("post_code string,city string", ("69001", "Lyon"), ("75001", "Paris"), ("13001", "Marseille"), ("00000", "la"), ("59000", "Lille"))


_DET = ", ".join(f"'{x}'" for x in T.DETERMINERS)


@query(rf"""WITH a AS (SELECT *, regexp_extract(address, '(?:^|\D)(\d{{5}})(?:\D|$)', 1) AS code, regexp_extract(address, '^(\d{{2,3}})(?:\D|$)', 1) AS num FROM {ADDRESSES.sql}), p AS (SELECT post_code, min(city) AS city FROM {CITIES.sql} GROUP BY post_code),
r AS (SELECT city AS new_city, row_number() OVER (ORDER BY city) - 1 AS k FROM (SELECT DISTINCT city FROM {CITIES.sql} WHERE lower(city) NOT IN ({_DET}))),
j AS (SELECT a.*, coalesce(city, '') AS city, {pick_sql("coalesce(city, '')", "'0'", "(SELECT count(*) FROM r)")} AS k FROM a LEFT JOIN p ON code = post_code), f AS (SELECT j.*, coalesce(new_city, '') AS new_city, {number_sql('code')} AS new_code, {number_sql('num')} AS new_num FROM j LEFT JOIN r ON j.k = r.k),
w AS (SELECT *, replace(address, CASE WHEN code <> '' THEN code ELSE chr(1) END, new_code) AS w1 FROM f), x AS (SELECT *, replace(w1, CASE WHEN num <> '' THEN num ELSE chr(1) END, new_num) AS w2 FROM w), y AS (SELECT *, replace(w2, CASE WHEN city <> '' THEN city ELSE chr(1) END, new_city) AS w3 FROM x)
SELECT doc_id, num AS original, new_num AS pseudo FROM y WHERE num <> '' UNION ALL SELECT doc_id, code, new_code FROM y WHERE code <> '' UNION ALL SELECT doc_id, city, new_city FROM y WHERE city <> '' UNION ALL SELECT doc_id, address, w3 FROM y WHERE address <> ''""")
def mask_addresses(spark, d):
    return S.mask_addresses(ADDRESSES.df(spark), CITIES.df(spark), KEY)


# --- splits, scores, corpora


def bucket_sql(value: str, key: str, n: int) -> str:
    return f"(CAST('0x' || substr(md5('{key}|' || {value}), 1, 8) AS BIGINT) % {n})"


@query(f"SELECT doc_id, CASE WHEN {bucket_sql('doc_id', 'split', 10000)} < 8000 THEN 'train' ELSE 'eval' END AS part, {bucket_sql('doc_id', 'fold', 10)} AS fold FROM labels")
def split_train_eval(spark, d):
    return E.folds(E.split(table(spark, d, "labels"))).select("doc_id", "part", "fold")


SCORED = Literal("doc_id bigint,gold string,guess string", (1, "a", "a"), (1, "a", "b"), (1, "b", "b"), (2, "b", "b"), (2, "c", "a"), (3, "c", "c"))
_REPORT = "SELECT label, tp, fp, fn, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END, 6) AS recall, round(CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END, 6) AS f1 FROM c"


@query(f"WITH s AS (SELECT * FROM {SCORED.sql}), l AS (SELECT gold AS label FROM s UNION SELECT guess FROM s), c AS (SELECT label, (SELECT count(*) FROM s WHERE gold = label AND guess = label) AS tp, (SELECT count(*) FROM s WHERE gold <> label AND guess = label) AS fp, (SELECT count(*) FROM s WHERE gold = label AND guess <> label) AS fn FROM l) {_REPORT}")
def token_report(spark, d):
    return E.token_report(SCORED.df(spark))


GOLD = Literal("doc_id bigint,label string,start bigint,end bigint", (1, "a", 0, 3), (1, "a", 5, 8), (1, "b", 9, 10))
GUESS = Literal("doc_id bigint,label string,start bigint,end bigint", (1, "a", 0, 3), (1, "a", 5, 9), (1, "c", 9, 10))


@query(f"""WITH j AS (SELECT coalesce(g.label, s.label) AS label, g.label IS NOT NULL AS g, s.label IS NOT NULL AS s FROM {GOLD.sql} g FULL JOIN {GUESS.sql} s ON g.doc_id = s.doc_id AND g.label = s.label AND g.start = s.start AND g."end" = s."end"), c AS (SELECT label, count(*) FILTER (WHERE g AND s) AS tp, count(*) FILTER (WHERE s AND NOT g) AS fp, count(*) FILTER (WHERE g AND NOT s) AS fn FROM j GROUP BY label) {_REPORT}""")
def field_report(spark, d):
    return E.field_report(GOLD.df(spark), GUESS.df(spark))


@query(f"SELECT count(*) AS instances, CAST(sum(ok) AS BIGINT) AS correct, round(avg(ok), 6) AS accuracy FROM (SELECT doc_id, min(CAST(gold = guess AS INT)) AS ok FROM {SCORED.sql} GROUP BY doc_id)")
def instance_report(spark, d):
    return E.instance_report(SCORED.df(spark))


MARKED = Literal("doc_id bigint,field_no bigint,pos bigint,tok string,label string", (1, 0, 0, "Main", "ANAT"), (1, 0, 1, "droite", "ANAT"), (1, 1, 2, "et", "other"), (1, 2, 3, "aspirine", "chem"))
_AL = "CASE lower(label) " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in ALIASES.items()) + " ELSE label END"


@query(f"SELECT doc_id, field_no, pos, tok, CASE WHEN row_number() OVER (PARTITION BY doc_id, field_no ORDER BY pos) = 1 AND lab <> 'other' THEN 'I-' || lab ELSE lab END AS label FROM (SELECT *, {_AL} AS lab FROM {MARKED.sql})")
def begin_marks(spark, d):
    return E.begin_marks(MARKED.df(spark))


SENTENCES = Literal("doc_id bigint,start bigint,end bigint", (1, 0, 10), (1, 10, 20), (1, 20, 30), (2, 0, 5))
CROSSING = Literal("doc_id bigint,start bigint,end bigint", (1, 8, 12), (1, 21, 25))


@query(f"""WITH RECURSIVE s AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start) AS k FROM {SENTENCES.sql}), x AS (SELECT s.*, EXISTS (SELECT 1 FROM {CROSSING.sql} e WHERE e.doc_id = s.doc_id AND e.start < s.start AND e."end" > s.start) AS j FROM s), g AS (SELECT *, sum(CAST(NOT j AS INT)) OVER (PARTITION BY doc_id ORDER BY k) AS g FROM x) SELECT doc_id, min(start) AS start, max("end") AS "end" FROM g GROUP BY doc_id, g""")
def sentence_merge(spark, d):
    return E.merge_sentences(SENTENCES.df(spark), CROSSING.df(spark))


RAW_LINES = Literal("doc_id bigint,token_no bigint,feature string", (1, 0, "a"), (1, 1, "b"), (1, 2, "c"), (2, 0, "d"))
KNOWN = Literal("doc_id bigint,token_no bigint,label string", (1, 0, "x"), (1, 2, "y"))


@query(f"SELECT r.doc_id, r.token_no, feature, coalesce(last_value(label IGNORE NULLS) OVER (PARTITION BY r.doc_id ORDER BY r.token_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'other') AS label, CAST(label IS NOT NULL AS INTEGER) AS matched FROM {RAW_LINES.sql} r LEFT JOIN {KNOWN.sql} k ON r.doc_id = k.doc_id AND r.token_no = k.token_no")
def label_alignment(spark, d):
    return E.align(KNOWN.df(spark), RAW_LINES.df(spark))


PASSAGES = Literal("doc_id bigint,text string", (1, "La main droite & le bras"), (2, "Rien"))
ANNOTATED = Literal("doc_id bigint,type string,text string,offset bigint,length bigint", (1, "ANAT", "main droite", 13, 11), (1, "ANAT", "main", 13, 4), (1, "ANAT", "bras", 30, 4))
_FIX = f"fx AS (SELECT a.doc_id, type, a.text, CAST(\"offset\" - first_value(CASE WHEN instr(p.text, a.text) > 0 THEN \"offset\" - (instr(p.text, a.text) - 1) ELSE 0 END) OVER (PARTITION BY a.doc_id ORDER BY \"offset\", length DESC, a.text) AS BIGINT) AS \"offset\", length FROM {ANNOTATED.sql} a JOIN {PASSAGES.sql} p ON a.doc_id = p.doc_id)"


@query(f"WITH {_FIX} SELECT * FROM fx")
def fix_offsets(spark, d):
    return C.repair_offsets(ANNOTATED.df(spark), PASSAGES.df(spark)).select("doc_id", "type", "text", "offset", "length")


@query(f"""WITH {_FIX} SELECT *, CAST(EXISTS (SELECT 1 FROM fx o WHERE o.doc_id = f.doc_id AND o."offset" <= f."offset" AND o."offset" + o.length >= f."offset" + f.length AND o.length > f.length) AS INTEGER) AS is_nested FROM fx f""")
def nested_entities(spark, d):
    return C.nested(C.repair_offsets(ANNOTATED.df(spark), PASSAGES.df(spark))).select("doc_id", "type", "text", "offset", "length", "is_nested")


@query(f"""WITH {_FIX}, n AS (SELECT *, EXISTS (SELECT 1 FROM fx o WHERE o.doc_id = f.doc_id AND o."offset" <= f."offset" AND o."offset" + o.length >= f."offset" + f.length AND o.length > f.length) AS inside FROM fx f),
ch AS (SELECT doc_id, text, unnest(range(0, length(text))) AS i FROM {PASSAGES.sql}), m AS (SELECT ch.doc_id, ch.i, substr(ch.text, CAST(ch.i + 1 AS INTEGER), 1) AS c, n.type, n."offset" = ch.i AS opens, n."offset" + n.length = ch.i + 1 AS closes FROM ch LEFT JOIN n ON n.doc_id = ch.doc_id AND NOT n.inside AND ch.i >= n."offset" AND ch.i < n."offset" + n.length)
SELECT doc_id, string_agg(CASE WHEN opens THEN '<' || type || '>' ELSE '' END || {_ESC.format('c')} || CASE WHEN closes THEN '</' || type || '>' ELSE '' END, '' ORDER BY i) AS tagged FROM m GROUP BY doc_id""")
def inline_annotate(spark, d):
    return C.annotate_inline(PASSAGES.df(spark), C.repair_offsets(ANNOTATED.df(spark), PASSAGES.df(spark)))


@query(f"SELECT DISTINCT type, text FROM {ANNOTATED.sql}")
def lexicon_extract(spark, d):
    from ..operators.gazetteer import lexicon_from_corpus

    return lexicon_from_corpus(ANNOTATED.df(spark))


@query()
def perceptron_labels(spark, d):
    """Rule labels learnt by a sequence labeller on a bounded sample of documents, then decoded over all of them: label counts, and how many agree."""
    docs = table(spark, d, "documents")
    return perceptron.confusion_texts(docs, perceptron.train_texts(docs))
