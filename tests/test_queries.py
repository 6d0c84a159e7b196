"""Every registered query of the reference's operators against its SQL, and properties that SQL doesn't show."""

import glob
import hashlib
import os
import re
import xml.etree.ElementTree as ET

import literal_sql
import pytest

import docloom.plans.queries_docs as queries_docs
import docloom.plans.queries_text  # noqa: F401
from docloom.operators import corpus, pseudonymize
from docloom.operators import tokens as K
from docloom.plans.registry import QUERIES, SQL
from docloom.sources import files
from docloom.streaming.files import run_batches, stream_texts

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def table(df):
    cols = sorted(df.columns)
    return df[cols].astype(str).replace({"None": "<null>", "nan": "<null>", "<NA>": "<null>"}).sort_values(cols).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    got, want = table(got), table(want)
    assert len(got) == len(want)
    differ = (got != want).any(axis=1)
    assert not differ.any(), f"{got[differ].head(3).to_dict('records')} and {want[differ].head(3).to_dict('records')}"


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_without_sql(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_tokens_give_the_text_back(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    back = K.explode_tokens(docs).groupBy("doc_id").agg(K.ordered_join("tok", "pos", "").alias("back"))
    assert docs.join(back, "doc_id").where("text <> back").count() == 0


def test_spaced_tokens_are_those_of_the_token_table(spark):
    docs = spark.createDataFrame([(1, "  Le  patient\n\tva bien .  "), (2, ""), (3, None), (4, " \n "), (5, "a@b.fr,12")], "doc_id long, text string")
    pick = lambda df: sorted((r["doc_id"], r["char_offset"], r["ws"], r["tok"]) for r in df.collect())
    assert pick(K.spaced_tokens(docs)) == pick(K.with_white_space(K.explode_tokens(docs))) != []


def test_no_original_survives(spark):
    docs = spark.createDataFrame([(1, "Paul Martin et PAUL, Paula; le Dr Martin au 0102"), (2, "Rien")], "doc_id long, text string")
    pairs = spark.createDataFrame([(1, "name", "Paul Martin", "Louis Petit"), (1, "name", "Paul", "Louis"), (1, "name", "Martin", "Petit"), (1, "phone", "0102", "9876")], "doc_id long, kind string, original string, pseudo string")
    mapping = pseudonymize.pseudonym_map(pairs)
    out = pseudonymize.apply_spans(docs, mapping)
    assert pseudonymize.survivors(out, mapping).count() == 0
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {1: "Louis Petit et LOUIS, Paula; le Dr Petit au 9876", 2: "Rien"}


def test_emitted_xml_is_well_formed(spark):
    for name in ("header_xml", "medic_xml", "patient_xml", "body_divs", "facsimile", "entities_xml"):
        for row in QUERIES[name](spark, SF).collect():
            ET.fromstring(row[1])
    for row in K.inline_tags(queries_docs.LABELED.df(spark), queries_docs.TAGS).collect():
        ET.fromstring(f"<r>{row['tagged']}</r>")


def test_readers_of_corpora(spark):
    tagged = spark.createDataFrame([(1, "<tei>Le <medic>Dr <persname>Paul Martin</persname></medic> vient</tei>"), (2, "<broken")], "doc_id long, xml string")
    rows = [(r["doc_id"], r["tok"], r["label"]) for r in corpus.read_tagged(tagged, {"medic": "medic", "persname": "persname"}).orderBy("doc_id", "pos").collect()]
    assert rows[:5] == [(1, "Le", "other"), (1, "Dr", "I-medic"), (1, "Paul", "I-persname"), (1, "Martin", "persname"), (1, "vient", "other")]
    assert rows[5][2] == "error"
    bioc = spark.createDataFrame([("<collection><document><id>d1</id><passage><annotation><infon key='type'>ANAT</infon><location offset='3' length='4'/><text>main</text></annotation></passage></document></collection>",)], "xml string")
    assert [tuple(r) for r in corpus.read_bioc(bioc).collect()] == [("d1", "ANAT", "main", 3, 4)]


def test_sources_and_sinks(spark, tmp_path):
    folder = tmp_path / "in" / "deep"
    folder.mkdir(parents=True)
    (folder / "a.PDF").write_bytes(b"%PDF")
    (folder / "b.txt").write_text("Docteur Paul\nLyon")
    assert files.with_digest(files.read_binary(spark, str(tmp_path / "in"))).first()["md5"] == hashlib.md5(b"%PDF").hexdigest().upper()
    assert files.read_binary(spark, str(tmp_path / "in")).count() == 1
    assert files.read_texts(spark, str(folder / "b.txt")).first()["text"] == "Docteur Paul\nLyon"
    pairs = spark.createDataFrame([("Paul", "Louis"), ("a b", "c d")], "original string, pseudo string")
    files.write_pairs(pairs, str(tmp_path / "map"))
    assert sorted(map(tuple, files.read_pairs(spark, str(tmp_path / "map")).collect())) == [("Paul", "Louis"), ("a b", "c d")]
    files.write_lexicons(spark.createDataFrame([("anat", "main"), ("anat", "main")], "type string, text string"), str(tmp_path / "lex"))
    assert files.read_lexicon(spark, str(tmp_path / "lex" / "type=anat"), "anatomy").count() == 1
    good, bad = files.merge_corpora([spark.createDataFrame([(1, "<a/>"), (2, " ")], "doc_id long, xml string")])
    assert (good.count(), bad.count()) == (1, 1)
    files.write_xml(good, str(tmp_path / "xml"))
    files.write_export(spark.createDataFrame([(1, "a;b\nc")], "doc_id long, text string"), str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), sep=";", header=True).first()["Raw_Text"] == "a,b c"


def test_commands(spark, tmp_path):
    """Every command and call runs over whole texts; XML parses, and null and blank texts don't break one."""
    from docloom import commands

    docs = spark.createDataFrame([(1, "Compte rendu\nDocteur Paul Martin\npaul@chu.fr 0102030405\n1 Motif\nUn texte <court>.\n- item\n1.2 Suite\nFin le 07/03/2019"), (2, None), (3, " \n"), (4, "Lyon")], "doc_id long, text string")
    for name, run in (commands.COMMANDS | commands.CALLS).items():
        rows = run(docs).collect()
        assert rows, name
        for r in rows:
            if "xml" in r:
                ET.fromstring(r["xml"])
    xml = {r["doc_id"]: r["xml"] for r in commands.COMMANDS["processFullText"](docs).collect()}
    assert "<title level=\"a\" type=\"main\">Compte rendu</title>" in xml[1] and '<head level="1" n="1">Motif</head>' in xml[1] and "<item>" in xml[1] and set(xml) == {1, 4}
    tagged = {r["doc_id"]: r["payload"] for r in commands.COMMANDS["createTrainingAnonym"](docs).collect()}
    assert not {"Compte", "Docteur", "Paul", "Motif", "Suite", "Fin", "0102030405", "paul"} & set(re.findall(r"\w+", tagged[1])) and "<persname>" in tagged[1]
    blank = {r["doc_id"]: r["payload"] for r in commands.COMMANDS["createTrainingBlank"](docs).collect()}
    marked = {r["doc_id"]: r["payload"] for r in commands.COMMANDS["createTraining"](docs).collect()}
    text = lambda x: "".join(ET.fromstring(f"<r>{x}</r>").itertext())
    assert text(blank[1]) == text(marked[1]) == docs.first()["text"]
    assert commands.CALLS["processMedic"](docs.where("doc_id = 1")).first()["xml"].startswith("<medic><roleName>Docteur</roleName>")


def test_entry_works_without_the_training_data_folders(tmp_path):
    """A copy of the repository without these files imports and lists its other queries; another import error is not hidden."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    to = tmp_path / "copy"
    shutil.copytree(root, to, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 90 and 'pipeline' not in q and not any(k.startswith('op') and k[2].isdigit() for k in q) and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=to, check=True, env={**os.environ, "PYTHONPATH": str(to)})
    (to / "docloom" / "llm").mkdir()
    (to / "docloom" / "llm" / "__init__.py").write_text("")
    (to / "docloom" / "llm" / "queries.py").write_text("import a_module_that_is_missing\n")
    assert subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__ as e; e.queries()"], cwd=to, capture_output=True, env={**os.environ, "PYTHONPATH": str(to)}).returncode


def test_tag_tables(spark):
    tagged = spark.createDataFrame([(1, "<tei><medic><roleName>Dr</roleName> <persName>Paul Martin</persName></medic> vient</tei>")], "doc_id long, xml string")
    rows = [(r["tok"], r["label"]) for r in corpus.read_tagged(tagged, corpus.tag_table("medic")).orderBy("pos").collect()]
    assert rows == [("Dr", "I-rolename"), ("Paul", "I-persname"), ("Martin", "persname"), ("vient", "other")]


def test_streaming_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("Paul 123456")
    q = run_batches(stream_texts(spark, str(tmp_path / "in")), K.entities, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert sorted(r["type"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["idno", "persname"]


def test_entity_queries_return_every_type(spark, duck):
    """Names too, from the rows of the SQL of ``entities``, which has all types."""
    import json

    rows = list(duck.execute(f"SELECT doc_id, offset_start, offset_end, type, raw_name FROM ({SQL['entities']}) ORDER BY ALL").fetchall())
    assert {r[3] for r in rows} == {"email", "idno", "value", "persname"}
    assert sorted(tuple(r[c] for c in ("doc_id", "offset_start", "offset_end", "type", "raw_name")) for r in QUERIES["entity_order"](spark, SF).collect()) == rows
    got = [(r["doc_id"], r["offset_start"], json.loads(r["json"])) for r in QUERIES["entity_text_json"](spark, SF).collect()]
    assert sorted((d, a, j["offsetEnd"], j["type"], j["rawName"]) for d, a, j in got) == rows
    xml = [(r["doc_id"], e) for r in QUERIES["entities_xml"](spark, SF).collect() for e in ET.fromstring(r["xml"])]
    assert sorted((d, int(e.get("start")), int(e.get("end")), e.get("type")) for d, e in xml) == [r[:4] for r in rows]


def test_body_entities_return_every_type(spark, tmp_path):
    lines = {(1, 0): "Paul Martin vient", (1, 2): "le 0102030405 a@b.fr", (2, 0): "Anne 12"}
    spark.createDataFrame([(1, "Paul Martin vient\n\nle 0102030405 a@b.fr"), (2, "Anne 12"), (3, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = {(1, 0, "persname", "Paul Martin"), (1, 2, "idno", "0102030405"), (1, 2, "email", "a@b.fr"), (2, 0, "persname", "Anne"), (2, 0, "value", "12")}
    got = QUERIES["body_entities"](spark, str(tmp_path)).collect()
    assert {(r["doc_id"], r["line_no"], r["type"], r["raw_name"]) for r in got} == want
    assert all(lines[r["doc_id"], r["line_no"]][r["offset_start"] : r["offset_end"]] == r["raw_name"] for r in got)


def test_vectors_cover_the_documents(spark, tmp_path):
    """One row for each token of ``documents`` that isn't blank; statuses and positions are those of the whole text."""
    import regex

    texts = {1: "Le Dr Paul\n\nvient le 07/03/2019.", 2: "mot " * 3000 + "fin", 3: None, 4: " \n", 500: "the end", 501: "the end"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = {(d, pos): m.group() for d, t in texts.items() for pos, m in enumerate(regex.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}|\p{L}+|\p{N}+|[^\p{L}\p{N}]", t or "")) if m.group().strip()}
    for name in sorted(n for n in QUERIES if n.startswith("vector_")):
        got = {(r["doc_id"], r["pos"]): r["features"].split(" ") for r in QUERIES[name](spark, str(tmp_path)).collect()}
        assert set(got) == set(want), name
        if name != "vector_pseudonymised":
            assert all(got[k][0] == w for k, w in want.items()), name
        if name == "vector_full_text":
            assert [got[2, p][11] for p in (0, 2, 6000)] == ["BLOCKSTART", "BLOCKIN", "BLOCKEND"]
            assert [got[2, p][-1] for p in (0, 3000, 6000)] == ["0", "5", "11"]


def test_pseudonyms_reach_every_document(spark, tmp_path):
    """Map and clusters are those of the documents, whatever their ids."""
    from itertools import groupby

    ids = (1, 39, 40, 500, 10**12)
    docs = [(i, f"le docteur Paul Martin{i % 7}\nvu par Anne, a.b@chu.fr no 0102030{i % 1000:03d}.") for i in ids] + [(7, "rien ici"), (8, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    run = lambda name: QUERIES[name](spark, str(tmp_path)).collect()
    original = {(i, k, o) for i in ids for k, o in (("name", "Paul Martin"), ("name", "Anne"), ("email", "a.b@chu.fr"), ("idno", f"0102030{i % 1000:03d}"))}
    assert {(r["doc_id"], r["kind"], r["original"]) for r in run("pseudonyms")} == original == {(r["doc_id"], r["kind"], r["original"]) for r in run("collect_identifiers")}
    assert {(i, "name", o) for i in ids for o in ("Paul", "Martin")} <= {(r["doc_id"], r["kind"], r["original"]) for r in run("pseudonym_components")}
    assert {(i, o) for i in ids for o in ("Paul", "PAUL", "martin", "Anne")} <= {(r["doc_id"], r["original"]) for r in run("pseudonym_table")}
    assert {r["doc_id"] for r in run("pseudonym_tsv")} == set(ids)
    assert {r["doc_id"]: r["replaced"] for r in run("apply_map")} == {**dict.fromkeys(ids, 5), 7: 0}
    features = {(r["doc_id"], r["features"].split(" ")[1]) for r in run("vector_pseudonymised")}
    names = {(r["doc_id"], r["original"]): r["pseudo"] for r in run("pseudonym_table")}
    assert {(i, names[i, o].lower()) for i in ids for o in ("Anne", f"0102030{i % 1000:03d}")} <= features

    def label(t):
        return "email" if "@" in t and len(t) > 1 else "idno" if t.isdigit() and len(t) >= 6 else "value" if t.isdigit() else "persname" if t[0].isupper() and t.isalpha() and len(t) > 1 else "other"

    want = {}
    for i, t in docs:
        toks = re.findall(r"[\w.]+@[\w.]+\.[a-z]{2,}|[^\W\d]+|\d+|[^\w\s]", t or "")
        want[i] = [(k, " ".join(g)) for k, g in groupby(toks, label)]
    assert {(r["doc_id"], r["cluster_no"], r["label"], r["text"]) for r in run("clusters")} == {(i, n, *c) for i, cs in want.items() for n, c in enumerate(cs, 1)}
    assert {(r["doc_id"], r["label"]) for r in run("label_map")} == {(i, k) for i, cs in want.items() for k, _ in cs}
    assert {r["doc_id"]: r["tagged"].count("<persName>") for r in run("inline_tags")} == {i: sum(k == "persname" for k, _ in cs) for i, cs in want.items() if cs}
    assert {r["doc_id"] for r in run("label_sequences")} == set(ids)
    assert {r["text"] for r in run("label_sequences")} == {"Paul Martin", "Anne"}


@pytest.mark.parametrize("name", ["clusters", "label_map", "inline_tags", "label_sequences", "pseudonyms", "pseudonym_components", "pseudonym_table", "pseudonym_tsv", "collect_identifiers"])
def test_operators_on_literals_against_sql(spark, duck, name):
    """The SQL of these queries is about literal rows, which have cases that documents don't."""
    from pyspark.sql import functions as F

    q = queries_docs
    labelled, pairs = q.LABELED.df(spark), q.PERSONAL.df(spark).withColumn("pseudo", pseudonymize.pseudo(F.col("kind"), F.col("original"), q.KEY))
    got = {
        "clusters": lambda: K.cluster(labelled).groupBy("doc_id", "cluster_no", "label").agg(K.ordered_join("tok", "pos", " ").alias("text")), "label_map": lambda: K.label_map(K.cluster(labelled)), "inline_tags": lambda: K.inline_tags(labelled, q.TAGS),
        "label_sequences": lambda: K.sequences(labelled, ("settlement",), ("marker",)), "pseudonyms": lambda: pairs, "pseudonym_components": lambda: pseudonymize.components(pairs), "pseudonym_table": lambda: pseudonymize.pseudonym_map(q.PAIRS.df(spark)),
        "pseudonym_tsv": lambda: pseudonymize.tsv(pseudonymize.pseudonym_map(q.PAIRS.df(spark))), "collect_identifiers": lambda: pseudonymize.collect(q.RECORDS.df(spark), ["pers_name", "idno", "phone", "email", "date"]),
    }[name]()
    assert table(got.toPandas()).equals(table(duck.execute(literal_sql.SQL[name]).df()))


def test_page_window_has_pages_0_to_2(spark, tmp_path):
    spark.createDataFrame([(1, "\n".join(f"line {k}" for k in range(130))), (2, "one\n\nthree"), (3, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r["doc_id"], r["line_no"], r["page"]) for r in QUERIES["page_window"](spark, str(tmp_path)).collect()}
    assert got == {(1, k, k // 40) for k in range(120)} | {(2, 0, 0), (2, 2, 0)}


def test_title_case_has_every_turn(spark):
    """By brute force, texts with a sharp s too: its title case is Ss."""
    rows = spark.read.parquet(f"{SF}/conversations.parquet").select("turn", "conv_id", "text").collect()
    title = lambda t: None if t is None else " ".join(w[:1].title() + w[1:].lower() for w in t.split(" "))
    assert any("ß" in (r["text"] or "") for r in rows)
    got = sorted(((r["conv_id"], r["turn"], r["title"]) for r in QUERIES["title_case"](spark, SF).collect()), key=str)
    assert got == sorted(((r["conv_id"], r["turn"], title(r["text"])) for r in rows), key=str)


def test_masked_values_show_nothing_of_the_original(spark):
    from pyspark.sql import functions as F

    values = [("date", "07/03/19"), ("date", "7-3-2019"), ("date", "7.3.19"), ("date", "1er août 1999"), ("date", "12 mars 19"), ("date", "le 7/3"), ("date", "2019-03-07"), ("idno", "0102030405"), ("phone", "06 11 22 33 44")]
    rows = spark.createDataFrame(values, "kind string, original string").withColumn("pseudo", pseudonymize.pseudo(F.col("kind"), F.col("original"), "k")).collect()
    assert all(r["pseudo"] != r["original"] and len(r["pseudo"]) >= 5 for r in rows)
    for r in rows[-2:]:
        assert len(r["pseudo"]) == len(r["original"]) and all(a != b for a, b in zip(r["original"], r["pseudo"], strict=True) if a.isdigit())
    assert [len(r["pseudo"]) for r in rows[:2]] == [8, 10]


def test_overlaps_are_dropped_left_to_right(spark):
    import random

    from docloom.operators.gazetteer import _without_overlap

    rng = random.Random(3)
    spans = {(d, c, a, a + rng.randrange(4)) for d in range(5) for c in "xy" for a in rng.sample(range(60), 30)}
    want = set()
    for d in range(5):
        for c in "xy":
            reach = -1
            for s in sorted(s for s in spans if s[:2] == (d, c)):
                if s[2] > reach:
                    want.add(s)
                    reach = s[3]
    df = spark.createDataFrame([(*s, "t") for s in spans], "doc_id int, class string, n_start int, n_end int, term string")
    assert {tuple(r)[:4] for r in _without_overlap(df).collect()} == want


def test_labels_do_not_depend_on_batches(spark):
    from docloom.operators import perceptron, runner

    docs = spark.createDataFrame([(i, "Paul va le 12 mars a Lyon . " * (3 + 40 * (i % 3))) for i in range(12)], "doc_id long, text string")
    toks = K.label_by_rules(K.explode_tokens(docs)).select("doc_id", "pos", "tok", "label")
    model = perceptron.train(toks)
    key, got = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before = spark.conf.get(key)
    for n in ("7", "1000", "10000"):
        spark.conf.set(key, n)
        got.append(sorted(map(tuple, perceptron.decode(toks, model).collect())))
    spark.conf.set(key, before)
    assert got[0] == got[1] == got[2] and len(got[0]) == toks.count()
    assert perceptron.decode(toks.limit(0), model).count() == 0
    assert runner.split_evaluate("medic", toks, 0.5).where("label = 'persname'").first()["f1"] == 1.0
    assert {r["fold"] for r in runner.fold_evaluate("medic", toks, 3).collect()} <= {0, 1, 2}
    with pytest.raises(ValueError, match="no trainer"):
        runner.train("none", toks)


def test_whole_documents(spark):
    """Left note, people, back matter, notes and entities stand in the document."""
    from docloom import commands

    text = "Compte rendu\nHôpital Nord\n12 rue Haute 69001 Lyon\nTél 04 05 06 07 08\nDocteur Paul Martin\nMadame Anne Roux\n1 Motif\nUn texte.\nRemerciements\nMerci a tous\nAnnexe 1\nUne table"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "seul")], "doc_id long, text string")
    xml = {r["doc_id"]: ET.fromstring(r["xml"]) for r in commands.COMMANDS["processFullText"](docs).collect()}
    assert set(xml) == {1, 3}
    root = xml[1]
    assert root.find(".//listOrg/org/orgName").text == "Hôpital Nord" and root.find(".//listOrg/org/address").text == "12 rue Haute 69001 Lyon" and root.find(".//listOrg/org/phone") is not None
    assert {p.get("type") for p in root.findall(".//listPerson")} == {"medic", "patient"}
    assert [d.get("type") for d in root.findall(".//back/div")] == ["acknowledgement", "annex"]
    assert [p.text for p in root.findall(".//back/div[@type='annex']/p")] == ["Annexe 1", "Une table"]
    assert "Merci" not in "".join(root.find(".//body").itertext()) and root.findall(".//back/entities/entity")
    note = {r["doc_id"]: r["xml"] for r in commands.CALLS["processLeftNoteDocument"](docs).collect()}
    assert set(note) == {1} and "<org>" in note[1]
    assert "<listOrg><org>" in {r["doc_id"]: r["xml"] for r in commands.CALLS["processHeaderDocument"](docs).collect()}[1]
