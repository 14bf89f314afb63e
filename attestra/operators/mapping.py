"""Records of another source, as JSON whose keys are spelt in several ways, mapped to typed columns.

A record is parsed once into a variant; each field is the first of its names, in any
of their spellings, that is there and not empty. Keys that are not asked for cost nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.records import imported as is_imported
from ..functions.records import product_slug
from ..functions.text import alcohol_text, contents_text, falsy_collapsed, text

# Names of each field in the order they are tried, and the public address of a form.
FORM_FIELDS = {
    "plant_registry_basic_permit_brewers_number": ["permit_number"],
    "source_of_product": ["domestic_or_imported"],
    "serial_number": ["serial_number"],
    "type_of_product": ["product_type"],
    "brand_name": ["brand_name"],
    "fanciful_name": ["product_name", "fanciful_name"],
    "applicant_name_address": ["address_text", "permit_number"],
    "formula_id": ["formula_code"],
    "type_of_application": ["application_type"],
    "date_of_application": ["application_date"],
    "date_issued": ["approval_date"],
    "qualifications": ["approval_qualifications"],
    "status": ["application_status"],
    "class_type_description": ["class_name"],
}


def spellings(name: str) -> list[str]:
    """A name as given, in capitals, in small letters, and with words run together, all but the first with a capital."""
    first, *rest = name.split("_")
    return list(dict.fromkeys([name, name.upper(), name.lower(), first + "".join(w.title() for w in rest)]))


def field(record: Column, *names: str) -> Column:
    """The first value of ``names`` in any spelling that is neither null nor empty, as text; empty without one."""
    keys = dict.fromkeys(k for n in names for k in spellings(n))
    return text(F.coalesce(*[F.nullif(F.try_variant_get(record, f"$['{k}']", "string"), F.lit("")) for k in keys]))


def number(record: Column, *names: str) -> Column:
    """The same as a number, null where it is none."""
    return F.nullif(field(record, *names), F.lit("")).try_cast("double")


def elements(record: Column, *names: str) -> Column:
    """The array of the first name that has one, as variants; empty without one."""
    keys = dict.fromkeys(k for n in names for k in spellings(n))
    return F.coalesce(*[F.try_variant_get(record, f"$['{k}']", "array<variant>") for k in keys], F.array().cast("array<variant>"))


def mapped(df: DataFrame, json: str, fields: dict[str, list[str]]) -> DataFrame:
    """``df`` with a text column for each of ``fields``: its names in the order they are tried. Null or broken JSON has all of them empty."""
    record = df.withColumn("_record", F.try_parse_json(json))
    return record.withColumns({name: field(F.col("_record"), *names) for name, names in fields.items()}).drop("_record")


def parsed_records(df: DataFrame, json: str) -> DataFrame:
    """``df`` with ``ttb_id``, ``form_fields`` and ``application`` of a record of the other source.

    The origin is the application's country only where the record is of an imported product.
    """
    r, plain = F.col("_record"), lambda *names: falsy_collapsed(field(F.col("_record"), *names))
    alcohol, contents = alcohol_text(number(r, "abv")), contents_text(number(r, "volume"), field(r, "volume_unit"))
    known = df.withColumn("_record", F.try_parse_json(json))
    known = known.withColumns({"ttb_id": F.trim(field(r, "ttb_id")), "_alcohol": alcohol, "_contents": contents, **{f"_{k}": plain(*names) for k, names in FORM_FIELDS.items()}, "_origin": plain("origin_name")})
    known = known.withColumn("_imported", is_imported(F.col("_source_of_product"), F.col("_origin")))
    form = F.struct("ttb_id", *[F.col(f"_{k}").alias(k) for k in FORM_FIELDS], F.col("_contents").alias("net_contents"), F.col("_alcohol").alias("alcohol_content"))
    application = F.struct(
        F.col("ttb_id").alias("fixture_id"), F.concat("ttb_id", F.lit(".json")).alias("filename"), product_slug(F.col("_type_of_product")).alias("product_type"), F.col("_brand_name").alias("brand_name"), F.col("_fanciful_name").alias("fanciful_name"),
        F.col("_class_type_description").alias("class_type"), F.col("_alcohol").alias("alcohol_content"), F.col("_contents").alias("net_contents"), F.when(F.col("_imported"), F.col("_origin")).alias("country_of_origin"), F.col("_imported").alias("imported"),
        F.col("_formula_id").alias("formula_id"), F.lit("").alias("statement_of_composition"),
    )
    return known.select(*df.columns, "ttb_id", form.alias("form_fields"), application.alias("application"))
