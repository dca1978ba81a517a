"""tablecraft: batch analytics and feature engineering as DataFrame functions.

Every operator takes DataFrames plus parameters and returns a DataFrame. The
caller owns the session, the action and the sink.
"""
