"""Many log files share tasks."""

from citeflow.sources import log_files


def test_many_files_share_tasks(spark, tmp_path):
    for i in range(700):
        (tmp_path / f"{i:04d}.log").write_text(f"a{i}\nb{i}\n")
    tail = log_files.log_file_tail(spark, str(tmp_path), 2)
    assert tail.rdd.getNumPartitions() < 100 and tail.count() == 1400
    assert log_files.files_a_task(60) == 1 and log_files.files_a_task(10**6) == log_files.FILES_A_TASK
