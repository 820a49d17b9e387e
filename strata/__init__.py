"""strata: structural queries over source trees and documents, on Spark."""
