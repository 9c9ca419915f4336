"""Declared schemas and the severity scales shared by all operators."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# The four severity labels, most severe first.
CONTRAINDICATED = "Contraindicated interaction"
MAJOR = "Major interaction"
MODERATE = "Moderate interaction"
MINOR = "Minor interaction"
LABELS = [CONTRAINDICATED, MAJOR, MODERATE, MINOR]
SEVERE_LABELS = [CONTRAINDICATED, MAJOR]


@dataclass(frozen=True)
class Scale:
    """A label -> number scale with its value for unknown or missing labels."""

    values: dict[str, float]
    default: float


# The label scales in use and their defaults.
WEIGHT_SCALE = Scale({CONTRAINDICATED: 10.0, MAJOR: 7.0, MODERATE: 4.0, MINOR: 1.0}, 4.0)
NUMERIC_SCALE = Scale({CONTRAINDICATED: 4, MAJOR: 3, MODERATE: 2, MINOR: 1}, 2)
ORDINAL_SCALE = Scale({"Contraindicated": 3, "Major": 2, "Moderate": 1, "Minor": 0}, 1)
ORDINAL_SCALE_STRICT = Scale({"Contraindicated": 3, "Major": 2, "Moderate": 1, "Minor": 0}, -1)
# Matched by substring of the lower-cased label, first hit wins.
SHARE_SCALE = Scale(
    {"contraindicated": 1.0, "major": 0.7, "moderate": 0.4, "minor": 0.15, "unknown": 0.2}, 0.2
)
PAIR_WEIGHT_SCALE = Scale({CONTRAINDICATED: 4, MAJOR: 3, MODERATE: 2, MINOR: 1}, 1)


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


INTERACTION_SCHEMA = T.StructType(
    [
        T.StructField("drugbank_id_1", T.StringType()),
        T.StructField("drugbank_id_2", T.StringType()),
        T.StructField("drug_name_1", T.StringType()),
        T.StructField("drug_name_2", T.StringType()),
        T.StructField("atc_1", T.StringType()),
        T.StructField("atc_2", T.StringType()),
        T.StructField("is_cardiovascular_1", T.BooleanType()),
        T.StructField("is_cardiovascular_2", T.BooleanType()),
        T.StructField("is_antithrombotic_1", T.BooleanType()),
        T.StructField("is_antithrombotic_2", T.BooleanType()),
        T.StructField("interaction_description", T.StringType()),
        T.StructField("severity_label", T.StringType()),
        T.StructField("severity_confidence", T.DoubleType()),
        T.StructField("severity_numeric", T.IntegerType()),
    ]
)

# Graph tables: every column is text, lists are "|"-joined.
NODE_SCHEMAS = {
    "drugs": _strings(
        "drugbank_id", "name", "type", "cas_number", "unii", "atc_codes", "groups", "indication",
        "mechanism_of_action", "smiles", "inchi_key", "molecular_weight", "logp", "pubchem_cid",
        "chembl_id", "kegg_id",
    ),
    "proteins": _strings(
        "protein_id", "name", "type", "uniprot_id", "gene_name", "organism", "general_function",
        "specific_function", "cellular_location", "actions", "source", "match_type",
    ),
    "side_effects": _strings("umls_cui", "name", "meddra_type", "source"),
    "diseases": _strings("mesh_id", "name", "source"),
    "pathways": _strings("smpdb_id", "name", "category", "enzymes", "source"),
    "categories": _strings("name", "mesh_id", "source"),
}
EDGE_SCHEMAS = {
    "ddi_edges": _strings("drug1_id", "drug2_id", "description", "severity", "source", "match_type"),
    "drug_protein_edges": _strings(
        "drug_id", "protein_id", "relationship_type", "actions", "known_action",
        "inhibition_strength", "induction_strength", "source", "match_type", "match_value",
    ),
    "drug_side_effect_edges": _strings(
        "drug_id", "side_effect_id", "frequency", "source", "match_type", "match_value"
    ),
    "drug_disease_edges": _strings(
        "drug_id", "disease_id", "relationship_type", "source", "match_type", "match_value"
    ),
    "drug_pathway_edges": _strings("drug_id", "pathway_id", "source"),
    "drug_category_edges": _strings("drug_id", "category_name", "source"),
    "snp_effects": _strings(
        "drug_id", "protein_name", "gene_symbol", "uniprot_id", "rs_id", "allele",
        "defining_change", "description", "pubmed_id", "source",
    ),
    "snp_adverse_reactions": _strings(
        "drug_id", "protein_name", "gene_symbol", "uniprot_id", "rs_id", "allele",
        "adverse_reaction", "pubmed_id", "source",
    ),
}
# Key columns that identify one edge of each kind.
EDGE_KEYS = {
    "ddi_edges": ["drug1_id", "drug2_id"],
    "drug_protein_edges": ["drug_id", "protein_id"],
    "drug_side_effect_edges": ["drug_id", "side_effect_id"],
    "drug_disease_edges": ["drug_id", "disease_id"],
    "drug_pathway_edges": ["drug_id", "pathway_id"],
    "drug_category_edges": ["drug_id", "category_name"],
}
