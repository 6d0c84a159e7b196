"""Batch commands and service calls as functions from (doc_id, text) to a DataFrame, and a command line over them.

    python -m docloom.commands processFullText --in FOLDER --out FOLDER
"""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import assembly as A
from .operators import documents as D
from .operators import evaluation as E
from .operators import flow
from .operators import pseudonymize as S
from .operators import tokens as K
from .sources import files

KEY = "demo"
ENTITY_TAGS = {name: name for name, _ in K.RULES}


def entity_tokens(docs: DataFrame) -> DataFrame:
    return K.label_by_rules(K.spaced_tokens(docs))


def pairs(docs: DataFrame, key: str = KEY) -> DataFrame:
    """(doc_id, kind, original, pseudo) of the personal data that the entity labeller finds, each once a document. ``key`` has to be secret for real data."""
    return flow.pairs(docs, key)


def pseudonyms(docs: DataFrame, key: str = KEY) -> DataFrame:
    """The map (doc_id, kind, original, pseudo) of :func:`pairs` and their parts."""
    return flow.pseudonym_map(docs, key)


def _training(docs: DataFrame, variant: str) -> DataFrame:
    toks = entity_tokens(docs)
    if variant == "pseudonymised":
        tagged = S.anonymised_tags(toks, pseudonyms(docs), ENTITY_TAGS)
    else:
        tagged = K.inline_tags(E.blank_training(toks), ENTITY_TAGS) if variant == "blank" else flow.tagged(docs, ENTITY_TAGS)
    return tagged.select("doc_id", F.lit("ner").alias("model"), F.lit(variant).alias("variant"), F.col("tagged").alias("payload"))


def blank(docs: DataFrame) -> DataFrame:
    return _training(docs, "blank")


def annotated(docs: DataFrame) -> DataFrame:
    return _training(docs, "annotated")


def anonymised(docs: DataFrame) -> DataFrame:
    return _training(docs, "pseudonymised")


def entities_of(docs: DataFrame) -> DataFrame:
    return A.entities_xml(K.entities(docs))


COMMANDS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "processHeader": D.header_documents,
    "processFullText": D.full_documents,
    "generateText": files.export_rows,
    "createTrainingBlank": blank,
    "createTraining": annotated,
    "createTrainingAnonym": anonymised,
    "createDataAnonymized": pseudonyms,
    "createTrainingBlankFrenchMedicalNER": blank,
    "createTrainingFrenchMedicalNER": annotated,
    "createTrainingAnonymFrenchMedicalNER": anonymised,
}
#: Calls of the service on strings and on documents.
CALLS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "processDateline": lambda docs: D.string_records(docs, "dateline"),
    "processMedic": lambda docs: D.string_records(docs, "medic"),
    "processPatient": lambda docs: D.string_records(docs, "patient"),
    "processNER": K.entities,
    "processHeaderDocument": D.header_documents,
    "processLeftNoteDocument": D.left_note_documents,
    "processFullMedicalText": D.full_documents,
    "processFrenchMedicalNER": entities_of,
}


def main(argv: list[str] | None = None) -> None:
    from .session import local_session

    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("command", choices=sorted(COMMANDS | CALLS))
    parser.add_argument("--in", dest="source", required=True, help="folder of text files")
    parser.add_argument("--out", required=True, help="folder for Parquet files")
    args = parser.parse_args(argv)
    spark = local_session()
    docs = files.read_texts(spark, args.source).select(F.xxhash64("path").alias("doc_id"), "text")
    (COMMANDS | CALLS)[args.command](docs).write.mode("overwrite").parquet(args.out)


if __name__ == "__main__":
    main()
