"""Literals, plans and rows, as the tests write them."""

import datetime as dtm


def t(text: str) -> dtm.datetime:
    return dtm.datetime.fromisoformat(text)


def d(text: str) -> dtm.date:
    return dtm.date.fromisoformat(text)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]
