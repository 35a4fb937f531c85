"""What is known in advance about the data sets: bins of quantised attributes, prediction targets, attribute orders."""

from __future__ import annotations

from collections.abc import Sequence

from tabloom.functions.rng import keyed
from tabloom.operators.evaluate import Target

# Bins of quantised numeric attributes.
BINS = {
    "adult": {"fnlwgt": 100, "capital-gain": 100, "capital-loss": 100},
    "tax": {"Salary": 50, "Rate": 10, "SingleExemp": 50, "MarriedExemp": 50, "ChildExemp": 50},
    "br2000": {},
    "tpch": {"c_acctbal": 100, "o_totalprice": 100},
}

# Prediction targets and what counts as positive.
TARGETS = {
    "adult": [
        Target("income", (">50k",)), Target("sex", ("female",)), Target("marital-status", ("never-married",)),
        Target("education", ("some-college", "assoc-voc", "assoc-acdm", "masters", "doctorate", "bachelors", "prof-school")),
        Target("age", None, 50, 100), Target("workclass", ("state-gov", "federal-gov", "local-gov")), Target("education-num", None, 10, 17),
        Target("occupation", ("prof-specialty",)), Target("relationship", ("unmarried",)), Target("race", ("black",)),
        Target("capital-gain", None, 0, 1000), Target("capital-loss", None, 0, 1000), Target("hours-per-week", None, 40, 100),
        Target("native-country", ("united-states",)),
    ],
    "tax": [
        Target("Gender", ("f",)), Target("AreaCode", None, 300, 400, "ac"),
        Target("City", (
            "watkins", "waterbury", "waters", "waterproof", "watrous", "watkinsville", "waterville", "watersmeet", "waterford", "watson", "waterville_valley", "waterbury_center",
            "watertown", "watonga", "wattsville", "watchung", "water_view", "waterford_works", "watford_city", "waterloo", "watton", "watseka", "water_valley",
        )),
        Target("State", ("wa",)), Target("Zip", tuple(f"zip98{code}" for code in range(1000))), Target("MaritalStatus", ("s",)), Target("HasChild", ("y",)),
        Target("Salary", None, 0, 10000), Target("Rate", None, 0, 3), Target("SingleExemp", None, 0, 0.1), Target("MarriedExemp", None, 0, 0.1), Target("ChildExemp", None, 0, 0.1),
    ],
    "br2000": [
        Target("a1", ("one",)), Target("a2", ("one", "two", "three", "four", "five", "six")), Target("a3", None, 4, 22),
        Target("a4", ("two", "three", "four", "five", "six", "seven", "eight", "nine")), Target("a5", None, 26, 91), Target("a6", ("one",)), Target("a7", ("one",)), Target("a8", ("zero",)),
        Target("a9", ("one",)), Target("a10", ("one", "two", "three")), Target("a11", None, 45, 92), Target("a12", ("one",)), Target("a13", None, 25, 91), Target("a14", ("one",)),
    ],
    "tpch": [
        Target("c_custkey", None, 0, 110000, "custkey_"), Target("c_nationkey", None, 0, 12, "nationkey_"),
        Target("n_name", ("vietnam", "china", "russia", "jordan", "indonesia", "japan", "india", "iran", "saudiarabia", "iraq")), Target("n_regionkey", ("regionkey_2", "regionkey_0", "regionkey_3")),
        Target("c_acctbal", None, -1000, 8000), Target("c_mktsegment", ("automobile", "household", "furniture", "building")),
        Target("o_orderpriority", ("2-high", "3-medium", "5-low", "4-notspecified")), Target("o_totalprice", None, 0, 300000), Target("o_orderstatus", ("o",)),
    ],
}

# The order in which the attributes are generated; the more special name comes first.
SEQUENCES = {
    "tax_part": ("AreaCode", "State"),
    "tax": ("AreaCode", "State", "Zip", "City", "HasChild", "MaritalStatus", "Salary", "Rate", "SingleExemp", "ChildExemp", "Gender", "MarriedExemp"),
    "adult_concat": ("education", "education-num", "sex_income", "race", "relationship", "marital-status", "workclass", "occupation", "native-country", "age", "hours-per-week", "fnlwgt", "capital-gain", "capital-loss"),
    "adult": ("education", "education-num", "sex", "income", "race", "relationship", "marital-status", "workclass", "occupation", "native-country", "age", "hours-per-week", "fnlwgt", "capital-gain", "capital-loss"),
    "br2000_concat": ("combo", "a9", "a12", "a10", "a2", "a4", "a3", "a5", "a13", "a11"),
    "br2000": ("a1", "a6", "a7", "a8", "a9", "a12", "a14", "a10", "a2", "a4", "a3", "a5", "a13", "a11"),
    "tpch": ("c_custkey", "c_mktsegment", "c_nationkey", "n_name", "n_regionkey", "o_orderstatus", "o_orderpriority"),
}


def _for(name: str, known: dict):
    """The entry all of whose parts (joined by _) occur in the name."""
    return next((v for k, v in known.items() if all(part in name for part in k.split("_"))), None)


def bins_for(name: str) -> dict[str, int]:
    return _for(name, BINS) or {}


def targets_for(name: str) -> list[Target]:
    return _for(name, TARGETS) or []


def sequence_for(name: str, columns: Sequence[str]) -> tuple[str, ...] | None:
    """The known order of a data set's attributes; None if there is none, or it is not for these columns."""
    found = _for(name, SEQUENCES)
    return found if found and set(found) == set(columns) else None


def random_sequence(columns: Sequence[str], seed: int) -> tuple[str, ...]:
    """An order that depends on the seed alone."""
    return tuple(sorted(columns, key=lambda c: keyed(seed, "sequence", c)))
