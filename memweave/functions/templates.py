"""Defaults of newly provisioned users; empty text counts as missing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the mail domain and of an unnamed user's organisation. What an unnamed user is called is a deployment's choice.
MAIL_DOMAIN, NO_NAME_ORG = "@clerk.local", "My Org"
NO_NAME = "New User"


def _given(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def default_email(user_id: Column, email: Column) -> Column:
    return F.coalesce(_given(email), F.concat(user_id, F.lit(MAIL_DOMAIN)))


def user_name(name: Column, otherwise: str = NO_NAME) -> Column:
    return F.coalesce(_given(name), F.lit(otherwise))


def org_name(name: Column) -> Column:
    return F.coalesce(F.concat(_given(name), F.lit("'s Org")), F.lit(NO_NAME_ORG))
