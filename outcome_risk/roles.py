"""Column roles: which column of a table plays which part."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Candidate column names per role, first present name wins.
CANDIDATES = {
    "target": ["Attrition"],
    "group": ["Department", "SubDepartment", "Dept"],
    "grade": ["Grade", "JobLevel", "Level"],
    "flag": ["OverTime", "Overtime"],
    "amount": ["MonthlyIncome", "Monthly Income", "Salary"],
    "age": ["Age", "age"],
    "role": ["JobRole", "Job Role", "Role"],
    "tenure": ["YearsAtCompany", "Tenure", "YearsInCurrentRole"],
    "id": ["EmployeeName", "EmployeeNumber", "EmpID", "EmpId"],
}
# The score keyword, columns of a report, columns that are dropped.
SCORE_KEYWORD = "satisfaction"
REPORT_EXTRAS = ["JobRole", "Department", "Grade", "JobLevel"]
CONSTANT_COLUMNS = ["Over18", "StandardHours", "EmployeeCount"]
NON_PREDICTIVE_COLUMNS = ["EmployeeName", "EmployeeNumber", "DateOfJoining"]


@dataclass(frozen=True)
class Roles:
    """The column name behind each role, or None where the table lacks it."""

    target: str | None = None
    group: str | None = None
    grade: str | None = None
    flag: str | None = None
    amount: str | None = None
    age: str | None = None
    role: str | None = None
    tenure: str | None = None
    id: str | None = None
    scores: tuple[str, ...] = ()

    def present(self) -> dict[str, str]:
        named = {f.name: getattr(self, f.name) for f in fields(self) if f.name != "scores"}
        return {role: column for role, column in named.items() if column}


def quoted(name: str) -> Column:
    """Column reference that survives spaces and dots in the name."""
    return F.col("`" + name.replace("`", "``") + "`")


def match_columns(columns: list[str], keyword: str = SCORE_KEYWORD) -> list[str]:
    """Names containing the keyword, whatever their case, in table order."""
    return [c for c in columns if keyword.lower() in c.lower()]


def resolve_roles(columns: list[str], overrides: dict[str, str] | None = None) -> Roles:
    """Find the column of every role by exact name; overrides win."""
    found = {
        role: next((name for name in names if name in columns), None)
        for role, names in CANDIDATES.items()
    }
    roles = Roles(scores=tuple(match_columns(columns)), **found)
    return replace(roles, **overrides) if overrides else roles


def select_roles(df: DataFrame, roles: Roles) -> DataFrame:
    """Project the table to its role columns, renamed to the role names."""
    return df.select(
        *[quoted(column).alias(role) for role, column in roles.present().items()],
        *[quoted(c) for c in roles.scores],
    )


def column_families(df: DataFrame, target: str | None = None) -> dict[str, str]:
    """Map each text or numeric column, the target aside, to its family."""
    families = {}
    for field in df.schema.fields:
        if field.name == target:
            continue
        if isinstance(field.dataType, T.StringType):
            families[field.name] = "categorical"
        elif isinstance(field.dataType, T.NumericType):
            families[field.name] = "numeric"
    return families


def drop_columns(df: DataFrame) -> DataFrame:
    """Remove the constant and the non-predictive columns where present."""
    return df.drop(*CONSTANT_COLUMNS, *NON_PREDICTIVE_COLUMNS)


def empty(df: DataFrame, schema: str) -> DataFrame:
    """The typed empty result of an operator whose role is absent."""
    return df.sparkSession.createDataFrame([], schema)
