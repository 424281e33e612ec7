import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from rolodeck.session import build_session

    s = build_session("local[4]", app="rolodeck-tests", **{"spark.sql.shuffle.partitions": "8"})
    yield s
    s.stop()


CONTACT_SCHEMA = ("id long, account_id int, first_name string, last_name string, email string, phone string, company string, "
                  "version int, created_at timestamp_ntz, updated_at timestamp_ntz, deleted_at timestamp_ntz")


def make_contacts(spark, rows):
    """rows: dicts with id, first, last and optional email/phone/company/created/updated/deleted/account/version."""
    from rolodeck.sources.contacts import with_generated_columns

    data = []
    for r in rows:
        created = r.get("created")
        data.append((r["id"], r.get("account", 0), r["first"], r["last"], r.get("email"), r.get("phone"), r.get("company"),
                     r.get("version", 1), created, r.get("updated", created), r.get("deleted")))
    return with_generated_columns(spark.createDataFrame(data, CONTACT_SCHEMA))


def make_tags(spark, rows):
    return spark.createDataFrame([(i, a, n, None) for i, a, n in rows], "id int, account_id int, name string, created_at timestamp_ntz")


def make_links(spark, rows):
    return spark.createDataFrame([(c, t, None) for c, t in rows], "contact_id long, tag_id int, created_at timestamp_ntz")
