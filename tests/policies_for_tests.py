"""A policy of a user's own."""


def oldest(hits):
    return hits.withColumn("order", hits["ts"])
