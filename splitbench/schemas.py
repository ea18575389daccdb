"""Row schemas of the files that come in and go out: as JSON Schema documents, and as checks over columns.

A schema is a table of fields; a field's kind says what its text may be.  The
JSON documents, the check of one row and the query for violations of a whole
table all follow from these tables.
"""

from __future__ import annotations

import datetime
import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .errors import ConfigurationError, IntegrityError
from .functions import text
from .operators.stats import BANDS, TRUTH_COLUMNS
from .plans.benchmark import ASSIGNMENT_COLUMNS, EXCLUSION_COLUMNS, REFERENCE_COLUMNS, SEQUENCE_COLUMNS

#: What the text of a kind matches as a whole.
_ID = "[A-Za-z0-9][A-Za-z0-9._:+-]{0,254}"
PATTERNS = {
    "id": _ID,
    "optional id": f"({_ID})?",
    "fragment id": "frag-[0-9a-f]{32}",
    "group id": "sha256:[0-9a-f]{64}",
    "sha256": "[0-9a-f]{64}",
    "optional date": "([0-9]{4}-[0-9]{2}-[0-9]{2})?",
    "optional fraction": r"(0(\.[0-9]+)?|1(\.0+)?|[1-9](\.[0-9]+)?[eE]-[0-9]*[1-9][0-9]*)?",
    "count": "0|[1-9][0-9]{0,17}",
    "positive": "[1-9][0-9]{0,17}",
    "words": r"[\s\S]+",
    "text": r"[\s\S]*",
    "json map": r"\{[\s\S]*\}",
    "json list": r"\[[\s\S]+\]",
}
CHOICES = {
    "label": ("virus", "host"),
    "optional label": ("virus", "host", ""),
    "topology": ("linear", "circular"),
    "optional topology": ("linear", "circular", ""),
    "strand": ("+", "-"),
    "side": ("train", "test", "excluded", "mixed"),
    "candidate side": ("", "train", "test"),
    "band": ("", *BANDS),
    "view": ("train", "test", "candidate_test", *(f"test_strata/{b}" for b in BANDS)),
    "coordinates": ("zero_based_half_open", "zero_based_half_open_unwrapped"),
    "protocol": ("reference_preflight", "random", "genome", "similarity", "temporal", "taxonomy"),
    "yes": ("true",),
}
_KIND = {
    "sequence_id": "id", "genome_id": "id", "label": "label", "accession_version": "optional id", "release_date": "optional date", "topology": "topology", "length_nt": "positive",
    "sha256": "sha256", "canonical_sha256": "sha256", "source_input_id": "group id", "taxonomy": "json map", "metadata_extra": "json map", "sequence_ids": "json list",
    "source_input_ids": "json list", "contig_count": "positive", "group_id": "group id", "partition": "side", "candidate_partition": "candidate side", "reason": "words", "taxon": "text",
    "similarity_bin": "band", "nearest_train_genome_id": "optional id", "max_train_similarity": "optional fraction", "similarity_coverage": "optional fraction", "similarity_method": "text",
    "strict_gate_train_genome_id": "optional id", "strict_gate_similarity": "optional fraction", "strict_gate_coverage": "optional fraction", "strict_gate_method": "text",
    "split": "protocol", "duplicate_of": "optional id", "source_sha256": "sha256", "source_accession_version": "optional id", "source_genome_id": "id", "source_content_group_id": "group id",
    "source_sequence_id": "id", "source_start": "count", "source_end": "positive", "coordinate_system": "coordinates", "strand": "strand", "fragment_length": "positive", "view": "view",
    "synthetic": "yes",
}
_RANKS = ("realm", "kingdom", "phylum", "class", "order", "family", "genus", "species")


def _fields(columns, **other: str) -> dict[str, str]:
    return {c: other.get(c, _KIND.get(c, "text")) for c in columns}


SCHEMAS = {
    "metadata-row": _fields(
        ("sequence_id", "genome_id", "label", "accession_version", "release_date", "topology", *_RANKS), genome_id="optional id", label="optional label", topology="optional topology"
    ),
    "truth-row": _fields(TRUTH_COLUMNS, sequence_id="fragment id"),
    "reference-row": _fields(REFERENCE_COLUMNS),
    "sequence-row": _fields(SEQUENCE_COLUMNS),
    "assignment-row": _fields(ASSIGNMENT_COLUMNS),
    "exclusion-row": _fields(EXCLUSION_COLUMNS),
}
#: A field that, if filled, needs others filled.
NEEDS = {"strict_gate_similarity": ("strict_gate_train_genome_id", "strict_gate_method")}
#: Kinds that a JSON row may hold as integers.
WHOLE = ("count", "positive")


def fields_of(schema: str) -> dict[str, str]:
    if schema not in SCHEMAS:
        raise ConfigurationError(f"unknown schema {schema!r}; known: {', '.join(SCHEMAS)}")
    return SCHEMAS[schema]


def json_schema(schema: str) -> dict:
    """The schema as a JSON Schema document."""

    def rule(kind: str) -> dict:
        if kind in CHOICES:
            return {"enum": list(CHOICES[kind])}
        if kind in WHOLE:
            return {"type": "integer", "minimum": WHOLE.index(kind)}
        if kind == "optional date":
            return {"anyOf": [{"const": ""}, {"type": "string", "format": "date"}]}
        plain = {"type": "string"} if kind == "text" else {"type": "string", "minLength": 1} if kind == "words" else {"type": "string", "pattern": f"^(?:{PATTERNS[kind]})$"}
        return plain | ({"contentMediaType": "application/json"} if kind.startswith("json") else {})

    fields = fields_of(schema)
    out = {
        "$schema": "https://json-schema.org/draft/2020-12/schema",
        "title": f"A {schema.replace('-', ' ')}",
        "type": "object",
        "properties": {name: rule(kind) for name, kind in fields.items()},
        "required": [name for name in fields if schema != "metadata-row" or name == "sequence_id"],
        "additionalProperties": {"type": "string"} if schema == "metadata-row" else False,
    }
    filled = lambda names: {"properties": {n: {"minLength": 1} for n in names}, "required": list(names)}
    if needs := [{"if": filled([name]), "then": filled(others)} for name, others in NEEDS.items() if name in fields]:
        out["allOf"] = needs
    return out


def _fine_text(kind: str, value: str) -> bool:
    if kind in CHOICES:
        return value in CHOICES[kind]
    if not re.fullmatch(PATTERNS[kind], value):
        return False
    if kind == "optional date" and value:
        try:
            datetime.date.fromisoformat(value)
        except ValueError:
            return False
    return not kind.startswith("json") or _fine_json(kind, value)


def _fine_json(kind: str, value: str) -> bool:
    repeated = []
    try:
        found = json.loads(value, object_pairs_hook=lambda pairs: repeated.extend([k for k, _ in pairs[len(dict(pairs)) :]]) or dict(pairs))
    except ValueError:
        return False
    if kind == "json map":
        return isinstance(found, dict) and not repeated and all(isinstance(v, str) for v in found.values())
    return isinstance(found, list) and bool(found) and all(isinstance(v, str) and v for v in found) and len(set(found)) == len(found)


def row_faults(row: dict, schema: str) -> list[tuple[str, str]]:
    """(field, fault) of one row; values are texts, or integers where the schema has them."""
    fields = fields_of(schema)
    out = [] if schema == "metadata-row" else [(name, "unknown") for name in row if name not in fields]
    for name, kind in fields.items():
        value = row.get(name)
        if value is None:
            if schema != "metadata-row" or name == "sequence_id":
                out.append((name, "missing"))
        elif isinstance(value, bool) or not isinstance(value, str) and not (isinstance(value, int) and kind in WHOLE) or not _fine_text(kind, str(value)):
            out.append((name, kind))
    out += [(other, f"needed by {name}") for name, others in NEEDS.items() if row.get(name) for other in others if not row.get(other)]
    return out


def validate_row(row: dict, schema: str) -> None:
    if faults := row_faults(row, schema):
        raise IntegrityError(f"{schema}: " + "; ".join(f"{name}: {fault}" for name, fault in faults[:5]))


def is_fine(kind: str, value: Column) -> Column:
    """Whether a text column (null counts as empty) is of a kind, in built-in expressions."""
    v = F.coalesce(value.cast("string"), F.lit(""))
    if kind in CHOICES:
        return v.isin(list(CHOICES[kind]))
    fine = v.rlike(rf"\A(?:{PATTERNS[kind]})\z")
    if kind == "optional date":
        return fine & ((v == "") | text.iso_date(v).isNotNull())
    if kind == "json map":
        keys = F.json_object_keys(v)
        return fine & F.coalesce((F.size(keys) == F.size(F.array_distinct(keys))) & F.from_json(v, "map<string,string>").isNotNull(), F.lit(False))
    if kind == "json list":
        found = F.from_json(v, "array<string>")
        unique = (F.size(found) == F.size(F.array_distinct(found))) & ~F.exists(found, lambda x: F.coalesce(x, F.lit("")) == "")
        return fine & F.coalesce(unique, F.lit(False))
    return fine


def schema_violations(df: DataFrame, schema: str, key: str) -> DataFrame:
    """(key, field, fault) for every cell of df that its schema does not allow; columns may be of any simple type.

    One pass over df without a shuffle: each row lists its faults.
    """
    fields = fields_of(schema)
    if absent := [n for n in fields if n not in df.columns and (schema != "metadata-row" or n == "sequence_id")]:
        raise IntegrityError(f"{schema}: no column {', '.join(absent)}")
    fault = lambda name, what: F.struct(F.lit(name).alias("field"), F.lit(what).alias("fault"))
    filled = lambda name: F.coalesce(F.col(name).cast("string"), F.lit("")) != ""
    found = [F.when(~is_fine(kind, F.col(name)), fault(name, kind)) for name, kind in fields.items() if name in df.columns]
    found += [F.when(filled(name) & ~filled(other), fault(other, f"needed by {name}")) for name, others in NEEDS.items() if name in fields for other in others]
    listed = F.filter(F.array(*found), lambda x: x.isNotNull())
    return df.select(F.col(key).cast("string").alias("key"), F.explode(listed).alias("f")).select("key", "f.field", "f.fault")
