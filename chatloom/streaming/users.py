"""Users and their free subscriptions from a stream of sign-ins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession

from ..operators import requests as rq
from .merged import EVERY, MergedTable

_NAME = "struct<request_id: bigint, value: string>"
PARTS = f"tg_uid bigint, first struct<request_id: bigint, username: string, language_code: string>, named {_NAME}, shown {_NAME}"


class UserStream(MergedTable):
    """Sign-ins (request_id, tg_uid, username, display_name, language_code), each user's summed up to its first one and its last names.

    These merge in any order, so the users are those of one batch of all
    requests, however the stream splits them and wherever it is begun again.
    """

    def __init__(self, spark: SparkSession, folder: str, every: int = EVERY):
        super().__init__(spark, folder, PARTS, rq.merged_sign_ins, every)

    def drain(self, sign_ins: DataFrame) -> None:
        super().drain(sign_ins, rq.sign_in_parts)

    def read(self, users: DataFrame, plans: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
        """(users with is_new, new subscriptions) of a table of old users after all sign-ins so far; a new user gets one subscription."""
        after = rq.users_after(users, super().read(), as_of)
        return after, rq.new_subscriptions(after, plans)
