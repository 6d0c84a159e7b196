"""SQL of operators over the literal rows of ``queries_docs``, which hold cases that documents don't."""

from docloom.plans.queries_docs import _CL, _ESC, _PSEUDO, _TAG, LABELED, PAIRS, PERSONAL, RECORDS, map_sql

SQL = {
    "clusters": f"WITH {_CL} SELECT doc_id, cluster_no, lab AS label, string_agg(tok, ' ' ORDER BY pos) AS text FROM ct GROUP BY ALL",
    "label_map": f"WITH {_CL} SELECT doc_id, lab AS label, string_agg(tok, ' ' ORDER BY pos) AS tokens FROM ct GROUP BY ALL",
    "inline_tags": f"""WITH {_CL}, g AS (SELECT doc_id, cluster_no, lab, min_by(ws, pos) AS ld, string_agg(CASE WHEN pos = first THEN '' ELSE ws END || {_ESC.format('tok')}, '' ORDER BY pos) AS t FROM (SELECT *, min(pos) OVER (PARTITION BY doc_id, cluster_no) AS first FROM ct) GROUP BY ALL)
SELECT doc_id, string_agg(ld || CASE WHEN {_TAG} IS NULL THEN t ELSE '<' || {_TAG} || '>' || t || '</' || {_TAG} || '>' END, '' ORDER BY cluster_no) AS tagged FROM g GROUP BY doc_id""",
    "label_sequences": f"""WITH t AS (SELECT *, label IN ('settlement') AS w FROM {LABELED.sql} WHERE label <> 'marker'), b AS (SELECT *, CASE WHEN w AND NOT coalesce(lag(w) OVER (PARTITION BY doc_id ORDER BY pos), false) THEN 1 ELSE 0 END AS o FROM t), c AS (SELECT *, CAST(sum(o) OVER (PARTITION BY doc_id ORDER BY pos) AS BIGINT) AS seq_no FROM b)
SELECT doc_id, seq_no, string_agg(tok, ' ' ORDER BY pos) AS text FROM c WHERE w GROUP BY doc_id, seq_no""",
    "pseudonyms": f"SELECT doc_id, kind, original, {_PSEUDO} AS pseudo FROM {PERSONAL.sql}",
    "pseudonym_components": f"""WITH p AS (SELECT doc_id, kind, original, {_PSEUDO} AS pseudo FROM {PERSONAL.sql}), z AS (SELECT doc_id, kind, list_filter(regexp_extract_all(original, '\\p{{L}}+|\\p{{N}}+|[^\\p{{L}}\\p{{N}}]'), lambda t: regexp_matches(t, '^[\\p{{L}}\\p{{N}}]')) AS o, list_filter(regexp_extract_all(pseudo, '\\p{{L}}+|\\p{{N}}+|[^\\p{{L}}\\p{{N}}]'), lambda t: regexp_matches(t, '^[\\p{{L}}\\p{{N}}]')) AS q FROM p),
y AS (SELECT doc_id, kind, o[i] AS original, q[i] AS pseudo FROM (SELECT *, unnest(range(1, least(len(o), len(q)) + 1)) AS i FROM z)) SELECT doc_id, kind, original, pseudo FROM p UNION ALL SELECT * FROM y WHERE length(original) > CASE WHEN kind = 'name' THEN 2 ELSE 1 END""",
    "collect_identifiers": f"""WITH e AS (SELECT doc_id, 'name' AS kind, pers_name AS v FROM {RECORDS.sql} UNION ALL SELECT doc_id, 'idno', idno FROM {RECORDS.sql} UNION ALL SELECT doc_id, 'phone', phone FROM {RECORDS.sql} UNION ALL SELECT doc_id, 'email', email FROM {RECORDS.sql} UNION ALL SELECT doc_id, 'date', date FROM {RECORDS.sql}),
s AS (SELECT doc_id, kind, unnest(regexp_split_to_array(v, '[;\\t]')) AS v FROM e WHERE v IS NOT NULL), t AS (SELECT DISTINCT doc_id, kind, trim(CASE WHEN kind = 'idno' THEN replace(v, '*', '') ELSE v END) AS original FROM s) SELECT * FROM t WHERE CASE kind WHEN 'idno' THEN length(original) > 1 WHEN 'name' THEN length(original) > 2 AND NOT contains(original, '.') ELSE length(original) > 0 END""",
    "pseudonym_table": f"WITH {map_sql(PAIRS.sql)} SELECT * FROM mp",
    "pseudonym_tsv": f"WITH {map_sql(PAIRS.sql)} SELECT doc_id, string_agg(original || chr(9) || pseudo, chr(10) ORDER BY kind, original) AS tsv FROM mp GROUP BY doc_id",
}
