"""HTML trees and their markdown, in plain Python: no Spark here."""
