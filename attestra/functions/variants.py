"""Ways in which a label may put an application's value, in the order in which they are tried."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import label_text, unquoted

# Spellings by unit, and by words in a class of beverage.
ALCOHOL_SPELLINGS = ["", "%", " % alcohol", "% alc", "% alc/vol", "% alcohol by volume"]
UNIT_SPELLINGS = {
    r"milliliter|ml": [" ml", "ml", " milliliters", " milliliter"],
    r"liter|\bl\b": [" l", "l", " liter", " liters"],
    r"pint": [" pint", " pints"],
    r"fluid ounce|fl oz|\boz\b": [" fl oz", " fl. oz.", " fluid ounce", " fluid ounces", " oz", "oz"],
    r"gal": [" gal", " gallon", " gallons"],
}
CLASS_SPELLINGS = {
    "straight bourbon whisky": ["straight bourbon whiskey", "bourbon", "whisky", "whiskey"], "straight bourbon whiskey": ["bourbon", "whisky", "whiskey"], "bourbon": ["bourbon", "whisky", "whiskey"],
    "london dry gin": ["london dry gin", "gin"], "gin": ["gin"], "vodka": ["vodka"], "tequila": ["tequila"], "mezcal": ["mezcal"], "rum": ["rum"], "brandy": ["brandy"], "liqueur": ["liqueur", "cordial"],
    "table red wine": ["table wine", "red wine"], "table white wine": ["table wine", "white wine"], "table wine": ["table wine"], "red wine": ["red wine"], "white wine": ["white wine"], "rose wine": ["rose wine"],
    "sparkling wine": ["sparkling wine"], "malt beverage": ["malt beverage", "malt beverages", "beer"], "malt beverages": ["malt beverage", "malt beverages", "beer"], "beer": ["beer"], "ale": ["ale"],
    "porter": ["porter"], "stout": ["stout"], "hard cider": ["hard cider", "cider"],
}


def _if(condition: Column, values: list[Column]) -> Column:
    return F.when(condition, F.array(*values)).otherwise(F.array().cast("array<string>"))


def field_variants(field: Column, value: Column) -> Column:
    """Distinct variants of a value, itself first; none of a blank one."""
    given = unquoted(value)
    plain, number = label_text(given), F.regexp_extract(given, r"\d+(?:\.\d+)?", 0)
    alcohol = _if(number != "", [F.concat(number, F.lit(s)) for s in ALCOHOL_SPELLINGS])
    contents = F.flatten(F.array(*[_if((number != "") & plain.rlike(p), [F.concat(number, F.lit(s)) for s in names]) for p, names in UNIT_SPELLINGS.items()]))
    classes = F.flatten(F.array(_if(plain.endswith(" fb"), [F.trim(F.regexp_replace(plain, " fb$", ""))]), _if(plain != "", [plain]), *[_if(plain.contains(k), list(map(F.lit, names))) for k, names in CLASS_SPELLINGS.items()]))
    origin = F.array(F.concat(F.lit("Product of "), given), F.concat(F.lit("Made in "), given))
    more = F.when(field == "alcohol_content", alcohol).when(field == "net_contents", contents).when(field == "class_type", classes).when(field == "country_of_origin", origin).otherwise(F.array().cast("array<string>"))
    return F.when(given == "", F.array().cast("array<string>")).otherwise(F.filter(F.array_distinct(F.concat(F.array(given), more)), lambda x: x != ""))
