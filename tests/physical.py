"""What the tests read off a query's plans."""


def plan_of(df) -> str:
    """Physical plan before adaptive changes."""
    return df._jdf.queryExecution().executedPlan().toString()
