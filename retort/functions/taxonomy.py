"""Families of solvents, agents and catalysts from a molecule's text and element set."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Solvents of a known family, and element groups.
SOLVENTS = {
    "O": "water",
    "CO": "alcohol_protic",
    "CCO": "alcohol_protic",
    "CC(C)O": "alcohol_protic",
    "C1CCOC1": "ether_aprotic",
    "COC": "ether_aprotic",
    "CN(C)C=O": "amide_polar_aprotic",
    "CS(C)=O": "sulfoxide_polar_aprotic",
    "CC#N": "nitrile_polar_aprotic",
    "ClCCl": "halogenated",
    "ClC(Cl)Cl": "halogenated",
    "c1ccccc1": "aromatic_nonpolar",
    "Cc1ccccc1": "aromatic_nonpolar",
    "CCCCCC": "aliphatic_nonpolar",
    "CCCCCCC": "aliphatic_nonpolar",
    "CCOC(C)=O": "ester_medium_polarity",
}
HALOGENS = ("Cl", "Br", "I", "F")
METALS = ("Li", "Na", "K", "Mg", "Ca", "Fe", "Co", "Ni", "Cu", "Zn", "Pd", "Pt", "Rh", "Ru", "Ir", "Ag", "Au", "Al", "Sn", "B")
TRANSITION_METALS = ("Fe", "Co", "Ni", "Cu", "Pd", "Pt", "Rh", "Ru", "Ir", "Ag", "Au")
CATALYST_MARKS = ("[Pd", "[Pt", "[Rh", "[Ru", "[Ni", "[Cu", "[Fe")


def _has(elements: Column, names: tuple[str, ...]) -> Column:
    return F.arrays_overlap(elements, F.array(*[F.lit(x) for x in names]))


def solvent_family(smiles: Column, molecule: Column) -> Column:
    """``molecule``: the toolkit's struct (valid, elements, hbd, logp, rings), null fields where invalid (CH6)."""
    text = F.trim(smiles)
    known = F.create_map(*[F.lit(x) for pair in SOLVENTS.items() for x in pair])
    elements = molecule["elements"]
    by_rule = (
        F.when(~F.coalesce(molecule["valid"], F.lit(False)), "unknown_solvent")
        .when(_has(elements, HALOGENS), "halogenated")
        .when(_has(elements, ("P", "S")), "heteroatom_polar_aprotic")
        .when(molecule["hbd"] > 0, "protic")
        .when((molecule["rings"] > 0) & (molecule["logp"] > 1.5), "aromatic_nonpolar")
        .when(molecule["logp"] > 2.0, "aliphatic_nonpolar")
        .otherwise("polar_aprotic")
    )
    return F.coalesce(F.try_element_at(known, text), by_rule)


def agent_family(molecule: Column) -> Column:
    """CH7. Boron counts among the metals, so its own family never comes up."""
    elements = molecule["elements"]
    return (
        F.when(~F.coalesce(molecule["valid"], F.lit(False)), "unknown_agent")
        .when(_has(elements, TRANSITION_METALS), "transition_metal_catalyst")
        .when(_has(elements, METALS), "metal_reagent_or_salt")
        .when(_has(elements, ("P",)), "phosphorus_reagent_or_ligand")
        .when(_has(elements, ("S",)), "sulfur_reagent")
        .when(molecule["charge"] != 0, "ionic_reagent")
        .when(molecule["mw"] < 80, "small_molecule_reagent")
        .otherwise("organic_reagent")
    )


def catalyst_family(smiles: Column, molecule: Column) -> Column:
    """CH8: null where the molecule is no catalyst."""
    marked = None
    for mark in CATALYST_MARKS:
        hit = F.contains(F.coalesce(smiles, F.lit("")), F.lit(mark))
        marked = hit if marked is None else marked | hit
    return F.when((agent_family(molecule) == "transition_metal_catalyst") | marked, "transition_metal_catalyst")
