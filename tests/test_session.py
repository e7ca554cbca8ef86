import pytest

from casewright import session


class Elsewhere:
    """A session whose executors run on other machines, without a shared folder."""

    class conf:  # noqa: N801
        @staticmethod
        def get(name, default=None):
            return default

    class sparkContext:  # noqa: N801
        master, applicationId = "spark://host:7077", "app"


def test_a_cluster_without_a_shared_folder_is_refused():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_folder(Elsewhere())


def test_stored_tables_are_read_back(spark):
    stored = session.cut_lineage(spark.range(5))
    assert sorted(r.id for r in stored.collect()) == list(range(5))
    assert stored.inputFiles()[0].find(session.own_folder(spark)) >= 0
