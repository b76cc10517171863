from plainword.llm import decontam


def test_tasks_of_the_fit_follow_the_passages(spark):
    """Few passages in 40 parts: no stage has 40 tasks that each deal out sums of all terms, and the basis is that of one part."""
    docs = spark.createDataFrame([(" ".join(f"w{i * j % 91}" for j in range(1, 40)),) for i in range(80)], "text string")
    rows = decontam.term_rows(docs)
    seen, n, passages = decontam.document_frequency(rows)
    idf = decontam.np.log((1 + n) / (1 + seen)).astype("float32") + decontam.np.float32(0.05)
    sc = spark.sparkContext
    parted = spark.createDataFrame(sc.parallelize(rows.collect(), 40), rows.schema)
    assert parted.rdd.getNumPartitions() == 40
    sc.setJobGroup("fit", "")
    got = decontam.latent_basis(parted, passages, ["w1 w2 w3"], idf)
    sc.setJobGroup("", "")
    told = sc.statusTracker()
    stages = [told.getStageInfo(s) for j in told.getJobIdsForGroup("fit") for s in told.getJobInfo(j).stageIds]
    assert stages and max(s.numTasks for s in stages if s) < 40
    one = decontam.latent_basis(rows.coalesce(1), passages, ["w1 w2 w3"], idf)
    assert decontam.np.allclose(got @ (got.T @ one), one, atol=1e-2)
