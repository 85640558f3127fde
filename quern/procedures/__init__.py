"""Procedures: batch jobs that read datasets and make others."""

from __future__ import annotations

from collections.abc import Callable

from . import features, learning, tabular
from ..sources import files

PROCEDURES: dict[str, Callable] = {
    "transform": tabular.transform, "melt": tabular.melt, "bucketize": tabular.bucketize, "ranking": tabular.ranking, "summary.statistics": tabular.summary, "dataset.stats": tabular.dataset_stats, "split": tabular.split,
    "permuter.run": tabular.permuter, "serial": tabular.serial, "null": tabular.null, "createEntity": tabular.create_entity, "script.run": tabular.script, "pool": features.pool,
    "tfidf.train": features.tfidf, "statsTable.train": features.stats_table, "statsTable.bagOfWords.train": features.bag_of_words, "experimental.distTable.train": features.dist_table,
    "kmeans.train": learning.kmeans, "gaussianclustering.train": learning.gaussians, "svd.train": learning.svd, "classifier.train": learning.classifier, "classifier.test": learning.test, "classifier.experiment": learning.experiment, "randomforest.binary.train": learning.forest, "svm.train": learning.svm, "probabilizer.train": learning.probabilizer, "embedding.neighbors": learning.neighbors, "tsne.train": learning.tsne,
    "import.text": files.import_text, "import.json": files.import_json, "export.csv": files.export_csv, "list.files": files.list_files, "import.sentiwordnet": files.import_sentiwordnet, "import.word2vec": files.import_word2vec, "experimental.import.xlsx": files.import_xlsx, "postgresql.import": files.import_jdbc,
}
