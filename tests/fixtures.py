"""Small literal frames (invented values) for edge cases."""
import datetime as dt

from domus.schema import LISTING


def wide(spark):
    d = dt.date(2020, 1, 1)
    rows = [
        # id, broker, status, price, lot, street, city, state, zip, bed, bath, house, sold
        (1, 7, "for_sale", 100.00, 10.0, 1.0, "Alpha", "X", 10001, 3, 1, 120.0, d),
        (2, 7, "sold", 50.00, 10.0, 2.0, "Alpha", "X", 10001, 2, 1, 120.0, d),
        (3, 7, "for_sale", 100.00, 0.0, 3.0, "Alpha", "X", 10001, 3, 1, 150.0, None),
        (4, 8, "for_sale", None, 10.0, 4.0, "Alpha", "X", 10001, 4, 2, 90.0, d),
        (5, 8, "sold", 0.00, 10.0, 5.0, "Alpha", "Y", 10002, None, None, None, d),
        (6, 8, "ready_to_build", 250000.00, 5.0, 6.0, "alpha", "Y", 10002, None, None, 80.0, None),
        (7, 7, "for_sale", 100.10, 10.0, 7.0, "Beta", "X", 10003, 1, 1, 60.0, d),
    ]
    return spark.createDataFrame(rows, LISTING)
