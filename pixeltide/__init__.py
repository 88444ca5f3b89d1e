"""Time series of rasters as Spark tables, and training-data operators (``pixeltide.llm``, loaded only on request)."""

from pixeltide.operators.regions import region_table
from pixeltide.plans.verbs import Config, calibrate, check, detect, evaluate, extrapolation_rmse, predictor, query_points, scored, summarised, train
from pixeltide.sources.models import read_model, read_profile
from pixeltide.sources.scenes import load_cube
from pixeltide.streaming.arrivals import each_arrival

__all__ = ["Config", "calibrate", "check", "detect", "each_arrival", "evaluate", "extrapolation_rmse", "load_cube", "predictor", "query_points", "read_model", "read_profile", "region_table", "scored", "summarised", "train"]
