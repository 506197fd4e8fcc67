"""Reading messages, trees and tables; writing tables and exports."""
