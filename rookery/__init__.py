"""Rookery: distributed feature engineering and linear models over labelled board positions."""
