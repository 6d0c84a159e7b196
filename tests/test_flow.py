"""Token work in one pass over whole documents, against the Columns and the operators on token tables."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from docloom.operators import flow, perceptron, pseudonymize
from docloom.operators import tokens as K
from docloom.operators.vectors import vector
from docloom.plans import queries_text

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


#: Queries on the tokens of whole documents: rows of a document never leave the task that holds its text.
ONE_PASS = (
    "tokens_delim", "entities", "clusters", "label_map", "inline_tags", "tagged_documents", "pseudonyms", "pseudonym_table", "apply_map", "survivors", "vector_pseudonymised", "vector_lexicon_flags",
    *(f"vector_{m}" for m in queries_text.VECTORS), *(f"known_{m}" for m in queries_text.KNOWN_OF),
)


@pytest.mark.parametrize("name", ONE_PASS)
def test_tokens_are_not_shuffled_or_sorted(spark, name):
    """One exchange, of whole texts; a lexicon of a few terms may be grouped and broadcast beside it."""
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    texts = plan.split("BroadcastExchange")[0]
    assert "Sort" not in plan and "Window" not in plan, plan
    assert sum("Exchange hashpartitioning(doc_id" in line for line in plan.splitlines()) == 1 and "SortMergeJoin" not in texts


ODD_TOKENS = ["a", "É", "ÉA", "éa", "Ab", "12", "123456", "٣٤٥", "²½", "Ⅷ", "ß", "ǅa", "a1", "a@b.fr", "www.x", "https://a", "1999", "2099", "août", "Mai", ".", ",", "–", "’", "…", "!?", "😀", "日本", "(", "]", "İst", "x_Y"]


def test_values_equal_their_columns(spark):
    """The Python twins of token features and pseudonyms answer as the Columns do."""
    from docloom.functions import features as X
    from docloom.functions import pseudonym as P
    from docloom.functions import text as T
    from docloom.functions import values as V
    from docloom.operators import pseudonymize as S

    t, low = F.col("t"), F.lower("t")
    made = {"tok": t, "low": low, **{f"p{n}": X.prefix(low, n) for n in range(1, 6)}, **{f"s{n}": X.suffix(low, n) for n in range(1, 6)}, "caps": X.capitalisation(t), "digit": X.digits(t), "single": X.single_char(t), "punct": X.punctuation(t), "shape": X.shape(t), "trimmed": X.trimmed_shape(X.shape(t)), "year": X.flag(X.is_year(t)), "month": X.flag(X.is_month(t)), "email": X.flag(X.is_email(t)), "http": X.flag(X.is_http(t))}
    rows = spark.createDataFrame([(x,) for x in ODD_TOKENS], "t string").select("t", X.serialise(*made.values()).alias("f")).collect()
    assert [r["f"] for r in rows] == [V.features(r["t"], list(made)) for r in rows]
    values = [("name", x) for x in ("Paul MARTIN", "Éa", "straße ΑΣ x", "İst iI", "ŉx ﬁn ǆa", "A  B")] + [("idno", x) for x in ("123456", "12 34 ٣", "7 mars 2019", "1/2/2019", "2019-1-2", "1.2.2019")] + [("email", x) for x in ("a.b@c.fr", "a@b.fr c@d.fr", ".@x")]
    df = spark.createDataFrame(values, "kind string, o string").select("kind", "o", S.pseudo(F.col("kind"), F.col("o"), "k").alias("p"), F.initcap("o").alias("i"), F.upper("o").alias("u"), F.lower("o").alias("l"), ((T.date_shape(F.col("o")) == 0) & ~F.col("o").rlike(r"^\p{N}+$")).alias("plain"), T.normalize_space(F.col("o")).alias("n"))
    for r in df.collect():
        assert V.MASKS[r["kind"]](r["o"], "k") == r["p"], r
        assert (V.initcap(r["o"]), r["o"].upper(), r["o"].lower(), V.plain(r["o"]), V.normalize_space(r["o"])) == (r["i"], r["u"], r["l"], r["plain"], r["n"]), r
    pairs = df.select(F.lit(1).cast("long").alias("doc_id"), "kind", F.col("o").alias("original"), F.col("p").alias("pseudo"))
    want = {r["original"]: (r["kind"], r["pseudo"]) for r in S.pseudonym_map(S.components(pairs)).collect()}
    assert flow.Swap("k").map_of({(r["kind"], r["o"], r["p"]) for r in df.collect()}) == want
    assert P.NAMES


def test_one_pass_equals_token_tables(spark):
    """Texts in one pass give what the operators on token tables give, a given map and texts over several slices included."""
    odd = ["", "  ", None, "Paul  MARTIN\n12 123456 a@b.fr c@d.fr <Roux> & \"x\" ", "\n\nA b\r\nC. é Éa ß 1²½ 日本   x\u0085 😀", "Éa " * 700]
    docs = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")
    same = lambda a, b: sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str)
    labelled = K.label_by_rules(K.spaced_tokens(docs))
    assert same(flow.clusters(docs), K.cluster(labelled).groupBy("doc_id", "cluster_no", "label").agg(K.ordered_join("tok", "pos", " ").alias("text")))
    assert same(flow.label_map(docs), K.label_map(K.cluster(labelled)))
    assert same(flow.tagged(docs, {"persname": "p n='1'", "email": "email"}), K.inline_tags(labelled, {"persname": "p n='1'", "email": "email"}))
    mapping = flow.pseudonym_map(docs, "k")
    swapped = pseudonymize.apply_map(K.explode_tokens(docs), mapping).groupBy("doc_id").agg(F.count("*").alias("tokens"), F.sum("replaced").alias("replaced"), K.ordered_join("tok", "pos", "").alias("text"))
    assert same(flow.swapped_texts(docs, "k").drop("originals"), swapped)
    assert same(vector(docs, "medic", replaced=mapping), vector(docs, "medic", key="k"))
    toks = K.label_by_rules(K.explode_tokens(docs)).select("doc_id", "pos", "tok", "label")
    model = perceptron.train_texts(docs)
    assert (model.emit == perceptron.train(toks).emit).all() and (model.move == perceptron.train(toks).move).all()
    columns = ("doc_id", "pos", "tok", "label", "guess")
    assert same(perceptron.decode_texts(docs, model).select(*columns), perceptron.decode(toks, model).select(*columns))
    assert same(perceptron.confusion_texts(docs, model), perceptron.decode(toks, model).groupBy("label", "guess").agg(F.count("*").alias("n")))


def test_texts_are_cut_as_the_pattern_says(spark):
    """Tokens cut with arrays of classes are those of the JVM's pattern: emails at all borders, all kinds of characters, slices with an offset."""
    import random
    import zlib

    import numpy as np
    import pyarrow as pa

    from docloom.functions import text as T

    r = random.Random(7)
    signs = ["a", "b", "é", "1", "٣", "@", ".", "-", "_", "fr", "com", " ", "\n", "%", "😀", "日", "ࡰ", "x.y", "\x00", "²"]
    texts = ["".join(r.choices(signs, k=r.randint(0, 30))) for _ in range(4000)] + [None, "", "@" * 50, "a@b.fré x", "éa@b.fr", "a@b.fr_c@d.fr", "a@b.c1fr2@d.fr"]
    docs, table = spark.createDataFrame(list(enumerate(texts)), "i long, t string"), np.frombuffer(zlib.decompress(flow.classes(spark)), np.uint8)
    for pattern, emails in flow.CUT_HERE.items():
        want = [x["k"] or [] for x in docs.orderBy("i").select(T.tokenize(F.col("t"), pattern).alias("k")).collect()]
        size, flat = flow.cut(pa.array(["é@b.fr", *texts], pa.string()).slice(1), table, emails)
        ends = np.r_[0, np.cumsum(size)].tolist()
        held = flat.to_pylist()
        assert [held[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)] == want


def test_token_queries_cut_no_text_in_the_jvm(spark):
    """A text crosses to Python once, as it is; features of a lexicon need no join."""
    for name in ONE_PASS:
        plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "regexp_extract_all(text" not in plan.split("MapInArrow")[-1] and "Join" not in plan, plan


def test_features_of_all_words_of_a_slice():
    """Features made with arrays, and by the short way, are those of single tokens."""
    from docloom.functions import values as V
    from docloom.operators.vectors import VECTORS

    words = [*ODD_TOKENS, "", "AB", "Ab", "aB", "ÉÉ", "٣٤٥٦", "1850", "123", "decembre", "Août", "Août.", "a b", "iİ", "abcdefgh"]
    held = type("Slice", (), {"words": words})()
    for columns in VECTORS.values():
        names = [x for x in columns if x not in flow.PLACED]
        want = [V.features(w, names) for w in words]
        assert flow.Lines(names)(held).to_pylist() == want and list(map(V.features_of(names), words)) == want


def _tokens(spark, rows):
    """The tokens of (doc_id, text) as one slice."""
    import zlib

    import numpy as np
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], names=["doc_id", "text"])
    return flow.Tokens(batch, np.frombuffer(zlib.decompress(flow.classes(spark)), np.uint8))


def test_labels_of_all_words_of_a_slice(spark, monkeypatch):
    """Labels made with arrays are those of single tokens, and runs ask for no single token."""
    words = [*ODD_TOKENS, "", " ", "\t", "\n", "\x85", "\xa0", "@", "a@", "1234567", "١٢٣٤٥٦", "²²²²²²", "12a", "A", "AB", "aB", "A1", "ǅ", "ÉÀ"]
    want = [flow.rule_label(w) for w in words]
    monkeypatch.setattr(flow, "rule_label", None)
    assert [flow.LABELS[k] for k in flow.rule_labels(words)] == want and not len(flow.rule_labels([]))
    t = _tokens(spark, [(1, None), (2, "Paul  MARTIN 123456 12"), (3, ""), (None, "a@b.fr Éa")])
    r = flow.Runs(t)
    assert [(row, flow.LABELS[k], t.text(a, b + 1)) for row, k, a, b in zip(r.row, r.kind, r.a, r.b, strict=True)] == [(1, "persname", "Paul  MARTIN"), (1, "idno", "123456"), (1, "value", "12"), (3, "email", "a@b.fr"), (3, "persname", "Éa")]


def test_swaps_by_numbers_equal_the_maps(spark, monkeypatch):
    """Tokens swapped by numbers are those of the map of each text, which is not made for them: parts, variants, ties, texts without id."""
    import random

    r = random.Random(11)
    signs = ["Paul", "PAUL", "paul", "Martin", "MARTIN", "Éa", "ÉA", "éa", "İst", "Straße", "STRASSE", "Al", "al", "123456", "1234567", "12", "٣٤٥٦٧٨", "a.b@c.fr", "A.B@c.fr", "a@b.fr_c@d.fr", "x", ",", "\n", "-"]
    rows = [(k if k % 7 else None, None if k % 50 == 1 else "".join(x + r.choice([" ", " ", "  ", ""]) for x in r.choices(signs, k=r.randint(0, 40)))) for k in range(400)]
    t, held = _tokens(spark, rows), flow.Swap("k").maps(_tokens(spark, rows))
    toks = [t.words[k] for k in t.code]
    want = [held.get(row, {}).get(w, (None, None))[1] for row, w in zip(t.row.tolist(), toks, strict=True)]
    monkeypatch.setattr(flow.Swap, "maps", None)
    hit = flow.Swap("k")(t)
    assert hit.tolist() == [w is not None for w in want] and hit.sum() > 1000
    assert [t.words[k] for k in t.code] == [x if w is None else w for x, w in zip(toks, want, strict=True)]
    none = _tokens(spark, [(1, ""), (2, None)])
    assert not flow.Swap("k")(none).any()


def test_apply_map_keeps_no_originals(spark):
    """Originals are made for those who ask for them only."""
    assert "originals" not in entry.queries()["apply_map"](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_lexicon_flags_equal_the_join(spark, monkeypatch):
    """Flags looked up with the features are those of the join that a large lexicon takes."""
    from docloom.operators import gazetteer, vectors

    docs = spark.createDataFrame([(1, "Paul vit à LYON, paul"), (2, None), (None, "Lyon Éa")], "doc_id long, text string")
    lex = gazetteer.lexicon(spark.createDataFrame([("Paul", "name"), ("lyon", "city"), ("Éa", "city"), ("éa", "name")], "term string, class string"))
    near = sorted(map(tuple, vector(docs, "medic", lex=lex, classes=("name", "city")).collect()), key=str)
    monkeypatch.setattr(vectors, "flags", lambda *a: None)
    assert near == sorted(map(tuple, vector(docs, "medic", lex=lex, classes=("name", "city")).collect()), key=str) and any(x[2].endswith(" 1 1") for x in near)


def test_long_tokens_are_not_held():
    """Answers are held for short tokens only, so that their memory is bounded by bytes and not by a number of tokens of any length."""
    columns = [x for x in queries_text.VECTORS["medic"] if x not in flow.PLACED]
    lines = flow.Lines(columns)
    lines.known.held.clear()
    words = [("xX" * 500)[:n] + "X" * (1000 - n) for n in range(200)] + ["a", "12"]
    out = lines(type("Slice", (), {"words": words})()).to_pylist()
    assert sum(map(len, lines.known.held)) < 1000 and {"a", "12"} <= set(lines.known.held)
    from docloom.functions import values as V

    assert out == [V.features(w, columns) for w in words]

    pseudo = flow.Known(lambda x: x[1])
    assert [pseudo(("name", w)) for w in words] == words and list(pseudo.held) == [("name", "a"), ("name", "12")]
