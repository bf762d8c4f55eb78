"""Column names with spaces, dots and accents work everywhere a name is taken."""

import pytest
from pyspark.sql import functions as F

from helpers import sample_frame, to_spark
from riskloom import (
    analyse_categorielle,
    analyse_quantitative,
    cramers_v_matrix,
    get_dummies,
    get_test_dummies,
    iv_by_variable,
    modality_order,
    stepwise_selection_categorical,
    summarize_model,
    transform_dataframe,
)
from riskloom.operators import charts
from riskloom.operators.levels import missing_rates, monthly_shares


@pytest.fixture(scope="module")
def table(spark):
    frame = sample_frame(250, seed=9).rename(
        columns={"niveau": "type client", "x": "rev.total", "y": "défaut 0/1", "mois": "mois, octroi"}
    )
    return to_spark(spark, frame).cache()


def test_profiles(table):
    tables = analyse_categorielle(table, "type client", "défaut 0/1", "mois, octroi")
    tables = tables | {"n_" + k: v for k, v in analyse_quantitative(table, "rev.total", "défaut 0/1", "mois, octroi").items()}
    for result in tables.values():
        assert result.collect()
    assert charts.level_bars(tables["bivarie"], "type client").collect()
    assert charts.stacked_shares(tables["temporel"], "mois, octroi", "type client").collect()
    assert charts.heat_map(tables["temporel"], "mois, octroi", "type client").collect()
    assert monthly_shares(tables["temporel"], "mois, octroi", "type client").collect()


def test_tables_of_many_columns(table):
    assert missing_rates(table).count() == 5
    assert iv_by_variable(table, ["type client", "mois, octroi"], "défaut 0/1").count() == 2
    assert modality_order(table, ["type client"], "défaut 0/1").columns == ["type client"]
    assert cramers_v_matrix(table.drop("id", "rev.total")).count() == 3
    assert transform_dataframe(table, {"rev.total": [10.0, 20.0]}).columns == table.columns


def test_model(spark, table):
    rows = table.where(F.col("`défaut 0/1`").isNotNull() & ~F.isnan("`défaut 0/1`"))
    rows = rows.select("type client", "mois, octroi", "défaut 0/1")
    learned = get_dummies(rows, "défaut 0/1")
    test = get_test_dummies(rows, learned.categ, keep=["défaut 0/1"])
    chosen = stepwise_selection_categorical(
        learned.frame, test, "défaut 0/1", ["type client", "mois, octroi"], direction="forward", criterion="aic"
    )
    assert chosen.best_vars[0] == "type client"
    card = summarize_model(rows, "défaut 0/1", chosen.best_model.coefficient_table(spark))
    assert card.where("variable = 'type client'").count() == len(learned.categ["type client"])
