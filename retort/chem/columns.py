"""The toolkit on columns: Arrow-batched functions, each run over distinct inputs where the caller dedups first."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retort.chem import molecule, reaction

SIDES = "reactants array<string>, products array<string>, reactants_valid boolean, products_valid boolean, parse_class string, canonical string"
MOLECULE = "valid boolean, molecule_id string, canonical_smiles string, inchikey string, formula string, scaffold string, mw double, logp double, hbd int, hba int, rings int, charge int, elements array<string>"


# Functions are wrapped when they are used: a worker that imports this module has no session.


def reaction_sides(c: Column | str) -> Column:
    """Sides, validity, parse class and canonical form of reaction texts (PR18, CH2); null is malformed."""
    return F.pandas_udf(_reaction_sides, SIDES)(c)


def canonical_molecule(c: Column | str) -> Column:
    return F.pandas_udf(_canonical_molecule, "string")(c)


def product_scaffold(c: Column | str) -> Column:
    return F.pandas_udf(_product_scaffold, "string")(c)


def reaction_fingerprint(c: Column | str) -> Column:
    """Words of both sides' fingerprints (CH3); null where the text isn't valid."""
    return F.pandas_udf(_reaction_fingerprint, "reactant array<bigint>, product array<bigint>")(c)


def _reaction_sides(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for text in texts:
        s = reaction.sides_of(text)
        rows.append((list(s.reactants), list(s.products), s.reactants_valid, s.products_valid, s.parse_class, reaction.canonical_reaction(text) if s.ok else None))
    return pd.DataFrame(rows, columns=[x.split()[0] for x in SIDES.split(", ")])


def _canonical_molecule(texts: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else molecule.canonical(t) for t in texts], dtype=object)


def _product_scaffold(texts: pd.Series) -> pd.Series:
    return pd.Series([reaction.product_scaffold(t) for t in texts], dtype=object)


def _reaction_fingerprint(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for text in texts:
        s = reaction.sides_of(text)
        rows.append([reaction.bit_words(reaction.side_bits(x)) for x in (s.reactants, s.products)] if s.ok else [None, None])
    return pd.DataFrame(rows, columns=["reactant", "product"])


def _describe(texts: pd.Series) -> pd.DataFrame:
    names = [x.split()[0] for x in MOLECULE.split(", ")]
    rows = []
    for text in texts:
        r = molecule.record(text) if text else None
        rows.append([r is not None, *[(r or {}).get(n) for n in names[1:]]])
    frame = pd.DataFrame(rows, columns=names)
    for c in ("hbd", "hba", "rings", "charge"):
        frame[c] = frame[c].astype("Int32")
    return frame


def describe_molecules(molecules: DataFrame, name: str = "molecule") -> DataFrame:
    """Adds ``info``, the catalogue record (CH4, CH5), to a frame of distinct molecules."""
    return molecules.withColumn("info", F.pandas_udf(_describe, MOLECULE)(F.col(name)))
