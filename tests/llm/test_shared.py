from types import SimpleNamespace

import pytest

from rankloom.llm import _shared as S


def test_a_cluster_must_name_its_shared_folder():
    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")
    session = SimpleNamespace(sparkContext=context, conf={})
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        S.shared_dir(session)
