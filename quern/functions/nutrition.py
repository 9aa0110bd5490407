"""Nutrition points, grades, reference shares and consistency as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The thresholds of the 2023 score for food and drink.
ENERGY = [335, 670, 1005, 1340, 1675, 2010, 2345, 2680, 3015, 3350]
SUGARS = [3.4, 6.8, 10, 14, 17, 20, 24, 27, 31, 34, 37, 41, 44, 48, 51]
SATURATED = [1, 2, 3, 4, 5, 6, 7, 8, 9, 10]
SALT = [0.2, 0.4, 0.6, 0.8, 1.0, 1.2, 1.4, 1.6, 1.8, 2.0, 2.2, 2.4, 2.6, 2.8, 3.0, 3.2, 3.4, 3.6, 3.8, 4.0]
PROTEIN = [2.4, 4.8, 7.2, 9.6, 12, 14, 17]
FIBRE = [3.0, 4.1, 5.2, 6.3, 7.4]
DRINK_ENERGY = [30, 90, 150, 210, 240, 270, 300, 330, 360, 390]
DRINK_SUGARS = [0.5, 2.0, 3.5, 5.0, 6.0, 7.0, 8.0, 9.0, 10.0, 11.0]
DRINK_PROTEIN = [1.2, 1.5, 1.8, 2.1, 2.4, 2.7, 3.0]
DRINK_FIBRE = [3.0, 4.1, 5.2, 6.3, 7.4, 8.0]
# Daily reference amounts by group (null: none is set).
REFERENCES = {
    "general": {"calories": 2000, "protein": 60, "fat": 60, "saturated_fat": 18, "carbohydrates": 300, "sodium": 2000, "cholesterol": 300, "fiber": 25},
    "toddler": {"calories": 1200, "protein": 20, "fat": None, "saturated_fat": None, "carbohydrates": None, "sodium": 1200, "cholesterol": None, "fiber": 15},
    "pregnant": {"calories": 2200, "protein": 65, "fat": 65, "saturated_fat": 18, "carbohydrates": 330, "sodium": 2000, "cholesterol": 300, "fiber": 30},
}
# Limits per 100 g of the personal warnings.
WARNINGS = {"hypertension": ("sodium", 400), "diabetes": ("sugar", 10), "hyperlipidemia": ("saturated_fat", 5)}


def points(value: Column, thresholds: list[float]) -> Column:
    """How many thresholds a value exceeds; null counts as none."""
    return sum(((F.coalesce(value > F.lit(float(t)), F.lit(False))).cast("int") for t in thresholds), F.lit(0))


def score(energy: Column, sugars: Column, saturated: Column, salt: Column, protein: Column, fibre: Column, fruit: Column, drink: Column, cheese: Column | None = None, red_meat: Column | None = None, sweetened: Column | None = None, water: Column | None = None) -> Column:
    """Struct of points_n, points_p, score, grade and the parts."""

    cheese, red_meat, sweetened, water = (F.lit(False) if c is None else c for c in (cheese, red_meat, sweetened, water))

    def either(a: Column, b: Column) -> Column:
        return F.when(drink, a).otherwise(b)

    parts = {
        "energy": either(points(energy, DRINK_ENERGY), points(energy, ENERGY)),
        "sugars": either(points(sugars, DRINK_SUGARS), points(sugars, SUGARS)),
        "sfa": points(saturated, SATURATED),
        "salt": points(salt, SALT),
        "sweetener": F.when(drink & sweetened, 4).otherwise(0),
    }
    meat = either(points(protein, DRINK_PROTEIN), points(protein, PROTEIN))
    plus = {
        "protein": F.when(red_meat, F.least(meat, F.lit(2))).otherwise(meat),
        "fibre": either(points(fibre, DRINK_FIBRE), points(fibre, FIBRE)),
        "fruit": F.when(fruit > 80, either(F.lit(6), F.lit(5))).when(fruit > 60, either(F.lit(4), F.lit(2))).when(fruit > 40, either(F.lit(2), F.lit(1))).otherwise(0),
    }
    n, p = sum(parts.values(), F.lit(0)), sum(plus.values(), F.lit(0))
    protein_out = ~drink & (n >= 11) & ~cheese & (plus["fruit"] != 5)
    total = n - F.when(protein_out, plus["fibre"] + plus["fruit"]).otherwise(p)
    return F.struct(n.alias("points_n"), p.alias("points_p"), total.alias("score"), grade(total, drink, water).alias("grade"), *(c.alias(k) for k, c in (parts | plus).items()))


def grade(total: Column, drink: Column, water: Column | None = None) -> Column:
    water = F.lit(False) if water is None else water
    food = F.when(total <= 0, "A").when(total <= 2, "B").when(total <= 10, "C").when(total <= 18, "D").otherwise("E")
    wet = F.when(water, "A").when(total <= 2, "B").when(total <= 6, "C").when(total <= 9, "D").otherwise("E")
    return F.when(drink, wet).otherwise(food)


def missing_inputs(**required: Column) -> Column:
    """Names of required inputs that are null, in the given order."""
    return F.filter(F.array(*(F.when(c.isNull(), F.lit(k)) for k, c in required.items())), lambda x: x.isNotNull())


def conflict(part: Column, total: Column) -> Column:
    """A part that exceeds its total by more than 0.1; null inputs do not conflict."""
    return F.coalesce(part > total + 0.1, F.lit(False))


def consistent(per_serving: Column, per_100: Column, serving: Column) -> Column:
    """Do both amounts agree with the serving size, within 6 % and at least 0.6; any null: no."""
    return F.coalesce(F.abs(per_100 * serving / 100 - per_serving) <= F.greatest(F.lit(0.6), F.abs(per_serving) * 0.06), F.lit(False))


def close(a: Column, b: Column) -> Column:
    """Equal within 1 % and at least 0.05; any null: no."""
    return F.coalesce(F.abs(a - b) <= F.greatest(F.lit(0.05), F.abs(b) * 0.01), F.lit(False))


def atwater(calories: Column, protein: Column, fat: Column, carbohydrates: Column) -> Column:
    """Does the energy lie within 10 % of 4, 9 and 4 kcal a gram; null where an input is."""
    return F.abs(protein * 4 + fat * 9 + carbohydrates * 4 - calories) <= calories * 0.1


def significant(value: Column) -> Column:
    """A number with six significant digits."""
    out = F.round(value, 10)
    for e in range(-4, 7):
        out = F.when(F.abs(value) >= 10.0**e, F.round(value, 5 - e)).otherwise(out) if e > -4 else out
    return out


def repairs(value: Column) -> Column:
    """The readings in which a leading digit 1..9 of the number's short text (six significant digits) was lost."""
    v = significant(value)
    digits = F.floor(F.log10(v)) + 1
    whole = F.when(v == 0, 1).when((v >= 1e6) | (v < 1e-4), digits).otherwise(F.greatest(digits, F.lit(1)))
    return F.when(v >= 0, F.transform(F.sequence(F.lit(1), F.lit(9)), lambda d: F.round(d * F.pow(F.lit(10.0), whole) + v, 6))).otherwise(F.array().cast("array<double>"))


def solved(per_serving: Column, per_100: Column, serving: Column) -> Column:
    """(per_serving, per_100, provenance) after the serving size's check: a single possible repair is made, a missing side derived."""
    of_100 = F.filter(repairs(per_100), lambda c: consistent(per_serving, c, serving))
    of_serving = F.filter(repairs(per_serving), lambda c: consistent(c, per_100, serving))
    out = lambda a, b, how: F.struct(a.cast("double").alias("per_serving"), b.cast("double").alias("per_100"), F.lit(how).alias("provenance"))
    return (
        F.when(serving.isNull() | consistent(per_serving, per_100, serving), out(per_serving, per_100, "read"))
        .when(per_serving.isNull() & per_100.isNull(), out(per_serving, per_100, "missing"))
        .when(per_100.isNull(), out(per_serving, F.round(per_serving * 100 / serving, 1), "derived_100"))
        .when(per_serving.isNull(), out(F.round(per_100 * serving / 100, 1), per_100, "derived_serving"))
        .when((F.size(of_100) == 1) & (F.size(of_serving) == 0), out(per_serving, F.get(of_100, F.lit(0)), "repaired_100"))
        .when((F.size(of_serving) == 1) & (F.size(of_100) == 0), out(F.get(of_serving, F.lit(0)), per_100, "repaired_serving"))
        .otherwise(out(per_serving, per_100, "inconsistent"))
    )
