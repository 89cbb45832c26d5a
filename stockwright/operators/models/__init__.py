"""Forecast models.

A model is a function (history) -> DataFrame of point forecasts, where history
has one row per (origin, series_id) with the training values as an array, in
order and without gaps. See ``registry``.
"""
