"""SQL for those queries of the training-data problems that SQL can express on whole tables."""

SQL = {
    # the exact round trip: decoding the ids gives back each text
    "p8_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
