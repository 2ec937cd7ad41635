"""millrace: a Spark-native engine that mills source trees and corpora into training data."""

__version__ = "0.1.0"
