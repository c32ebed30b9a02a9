"""Row-level security: a viewer sees the rows of the accounts granted to them."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def visible_to(
    rows: DataFrame,
    rules: DataFrame,
    principal: str,
    rule_principal: str = "principalarn",
    account: str = "accountid",
) -> DataFrame:
    """Rows whose account one of the viewer's rules names; without a rule nothing is visible."""
    granted = rules.where(F.col(rule_principal) == principal).select(account).distinct()
    return rows.join(granted, account, "left_semi")
