"""Query and oracle of operator 4 (quotation linking)."""

from __future__ import annotations

from rolodeck.llm.quote_links import as_mail, conversations_by_quotes
from rolodeck.llm.staging import table


def op4_quote_links(spark, sf_dir):
    """The conversations, told as mail without thread ids and linked again by what the messages quote."""
    return conversations_by_quotes(as_mail(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")))


#: The threads as the table has them: a turn answers the one before it, unless there is none or it has no words.
ORACLE_4 = r"""
WITH t AS (SELECT conv_id, turn, min(struct_pack(a := role, b := coalesce(text, ''))) AS m FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY 1, 2),
s AS (SELECT conv_id, turn, m.a AS author, trim(m.b, E' \t\n\r') AS body, lag(turn) OVER w = turn - 1 AND lag(trim(m.b, E' \t\n\r')) OVER w <> '' AS answers FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
r AS (SELECT *, max(CASE WHEN coalesce(answers, false) THEN NULL ELSE turn END) OVER (PARTITION BY conv_id ORDER BY turn) AS root FROM s)
SELECT conv_id || '-' || root AS thread_id, CAST(turn - root + 1 AS BIGINT) AS position, CAST(turn - root AS INT) AS depth, conv_id || '-' || turn AS msg_id,
       CASE WHEN turn > root THEN conv_id || '-' || (turn - 1) END AS parent_id, author, body FROM r
"""

QUERIES = {"op4_quote_links": op4_quote_links}
ORACLE = {"op4_quote_links": ORACLE_4}
