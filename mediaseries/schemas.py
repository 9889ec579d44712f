"""Explicit schemas of every input; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


_S, _L, _D, _B = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType()

# The canonical post columns, in their order.
POST = _schema(
    id=_L, user_id=_L, username=_S, full_name=_S, datetime=_S, text=_S, replies=_L, retweets=_L,
    hashtags=_S, favorites=_L, links=_S, location=_S, bio=_S, user_created=_S, followers=_L,
    friends=_L, verified=_S, source=_S, retweet=_S, follows=_L, label=_S, profile_img=_S,
    google_map=_S, link=_S, url=_S, permalink=_S, sent=_S, sent_score=_D, pol=_D, sens=_D,
    likes=_L, to_user=_S, to_user_id=_L, lang=_S, lat=_D, long=_D, conf=_D,
)

# Crawled article columns, positional in their headerless file.
ARTICLE = _schema(title=_S, media=_S, datetime=_S, desc=_S, link=_S, img=_S, text=_S, summary=_S)

# One chat message as exported to JSON.
MESSAGE = T.StructType([
    T.StructField("_", _S), T.StructField("id", _L), T.StructField("date", _S),
    T.StructField("message", _S),
    T.StructField("from_id", T.StructType([T.StructField("_", _S), T.StructField("user_id", _L)])),
    T.StructField("views", _L), T.StructField("forwards", _L),
])

DAILY_INFO = _schema(date=T.DateType(), label=_S, count=_L, conf=_D)
