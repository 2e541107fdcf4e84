"""Course numbers, grades and credits."""

from pyspark.sql import Column, functions as F

from cohortlens.functions.nulls import first_of, in_list, is_true, text

# Grade classes.
EFFECTIVE = ["A", "B", "C", "D", "F", "I"]
COUNTED = ["A", "B", "C", "D", "F"]
EARNED = ["A", "B", "C", "D", "S", "P", "N", "*", ""]
NOT_ATTEMPTED = ["W", "X", "XN"]
NOT_PASSED = ["F", "I", "R", "U", "W", "X", "XN", "XY"]
UNKNOWN = ["", "*", "K", "N", "Z", "XN", "R", "I", "X", "XY"]
AUDITED = ["X", "XY", "XN", "R"]
OUTCOME = ["A", "B", "C", "D", "F", "W"]
PASSED_WELL = ["A", "B", "C"]


def clean_course_number(num: Column) -> Column:
    """``1234L`` loses its first character, ``123L`` its last; the order matters."""
    trimmed = F.when(num.rlike("^[0-9]{4}L$"), F.substring(num, 2, 10)).otherwise(num)
    return F.when(trimmed.rlike("^[0-9]{3}L$"), F.substring(trimmed, 1, 3)).otherwise(trimmed)


def is_college_level(num: Column) -> Column:
    return is_true(num.rlike("^[1-9][0-9][0-9]$"))


def is_second_year(num: Column) -> Column:
    return is_true(num.rlike("^2[0-9][0-9]$"))


def is_developmental(num: Column) -> Column:
    return ~is_true(num.rlike("^[12][0-9][0-9]$"))


def is_short_number(num: Column) -> Column:
    return in_list(num, ["I", "II", "III", "IV"]) | is_true(F.length(num) < 3)


def points(grade: Column) -> Column:
    return first_of((grade == "A", 4), (grade == "B", 3), (grade == "C", 2), (grade == "D", 1), default=0)


def course_points(grade: Column) -> Column:
    """As :func:`points`, with satisfactory and pass grades worth an A."""
    return F.when(grade.isin("S", "P"), 4).otherwise(points(grade))


def credit_if(credit: Column, cond: Column) -> Column:
    return F.when(is_true(cond), credit).otherwise(F.lit(0.0))


def effective_credit(credit: Column, grade: Column, grades=EFFECTIVE) -> Column:
    return credit_if(credit, in_list(grade, grades))


def graded_credit(credit: Column, grade: Column) -> Column:
    """Credit of rows with a known grade other than a withdrawal."""
    return credit_if(credit, ~in_list(grade, UNKNOWN + ["W"]))


def adjusted_credit(credit: Column, grade: Column) -> Column:
    return F.when(text(grade) == "W", credit / 3).when(in_list(grade, AUDITED), credit / 2).otherwise(credit)


def audit_halved(credit: Column, grade: Column) -> Column:
    return F.when(in_list(grade, ["X", "XN"]), credit / 2).otherwise(credit)
