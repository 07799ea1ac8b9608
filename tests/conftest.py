import os
import sys
from datetime import date
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from vocabgraph.sources.tables import VocabularyTables  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", os.environ.get("TEST_DRIVER_MEMORY", "6g"))
        .config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    if not Path(SF).exists():
        pytest.skip("no test data")
    return SF


CONCEPT = "concept_id long, concept_name string, concept_code string, vocabulary_id string, domain_id string, concept_class_id string, standard_concept string, valid_start_date date, valid_end_date date, invalid_reason string"
RELATION = "concept_id_1 long, concept_id_2 long, relationship_id string, valid_start_date date, valid_end_date date, invalid_reason string"
PREDICATE = "relationship_id string, relationship_name string, reverse_relationship_id string, is_hierarchical boolean, defines_ancestry boolean"
ANCESTOR = "ancestor_concept_id long, descendant_concept_id long, min_levels_of_separation int"
SYNONYM = "concept_id long, concept_synonym_name string"
FIRST, LAST = date(1990, 1, 1), date(2099, 12, 31)
UP = [(2, 1, None), (3, 1, None), (4, 2, None), (4, 3, None), (5, 3, None), (7, 3, "D")]
PREDICATES = [
    ("Is a", "Is a", "Subsumes", True, False), ("Subsumes", "Subsumes", "Is a", True, True), ("Maps to", "Maps to standard", "Mapped from", False, False), ("Mapped from", "Mapped from non-standard", "Maps to", False, False),
    ("Has site", "Has site", "Site of", False, False), ("Site of", "Site of", "Has site", False, False), ("Replaced by", "Item replaced by", "Replaces", False, False), ("Related", "Related item", None, False, False),
]


@pytest.fixture(scope="session")
def golden(spark):
    """Nine concepts that can be checked by hand."""
    concepts = [(i, f"c{i}", f"k{i}", "V2" if i == 6 else "V1", "Site" if i == 8 else "Thing", "x", None if i in (6, 7) else "S", FIRST, LAST, "D" if i == 7 else None) for i in range(1, 10)]
    edges = [(a, b, "Is a", r) for a, b, r in UP] + [(b, a, "Subsumes", r) for a, b, r in UP] + [(6, 4, "Maps to", None), (4, 4, "Maps to", None), (4, 6, "Mapped from", None), (4, 8, "Has site", None), (8, 4, "Site of", None)]
    ancestors = [(b, a, 1) for a, b, r in UP if r is None] + [(1, 4, 2), (1, 5, 2)]
    return VocabularyTables.from_frames(
        spark.createDataFrame(concepts, CONCEPT), spark.createDataFrame([(a, b, p, FIRST, LAST, r) for a, b, p, r in edges], RELATION), spark.createDataFrame(PREDICATES, PREDICATE), spark.createDataFrame(ancestors, ANCESTOR),
        spark.createDataFrame([(4, "syn four"), (4, "100% c"), (99, "orphan")], SYNONYM),
    )


@pytest.fixture(scope="session")
def empty_tables(spark):
    return VocabularyTables.from_frames(*[spark.createDataFrame([], s) for s in (CONCEPT, RELATION, PREDICATE, ANCESTOR, SYNONYM)])
