"""Analytics on irregular grouped time series, as DataFrame -> DataFrame functions."""
